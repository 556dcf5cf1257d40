"""Signatures, keys, canonical JSON and the order of a log in several files."""

import hashlib
import json
import os
import random
import stat

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import fields, jsontext, signing
from docloom.operators import audit
from docloom.sources import files

# Published vectors of RFC 8032: private key, public key, message, signature.
VECTORS = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
]


@pytest.mark.parametrize(("seed", "public", "message", "signature"), VECTORS)
def test_vectors(seed, public, message, signature):
    seed, public, message, signature = map(bytes.fromhex, (seed, public, message, signature))
    assert signing.public_of(seed) == public and signing.signatures(seed, [message]) == [signature]
    for copies in (1, 20):  # with and without a table of the key's multiples
        assert signing.verified(public, [(message, signature)] * copies) == [True] * copies
        wrong = [(message + b"x", signature), (message, signature[:32] + bytes(32)), (message, b"\x01" + signature[1:]), (message, signature[:-1]), (message, b""), (message, signature[:32] + (int.from_bytes(signature[32:], "little") + signing.ORDER).to_bytes(32, "little"))]
        assert signing.verified(public, wrong * copies) == [False] * (6 * copies)
    assert signing.verified(bytes(31), [(message, signature)]) == [False] and signing.verified(b"\xff" * 32, [(message, signature)]) == [False]


def test_many_rows_are_summed_together(monkeypatch):
    """Rows that share a key are signed and verified without a walk of their own, to the same bytes; odd scalars too."""
    seed, messages = bytes(range(32)), [f"entry {i}".encode() for i in range(300)]
    want = [signing.signatures(seed, [m])[0] for m in messages]
    public, scalars = signing.public_of(seed), [0, 1, 255, 256, signing.ORDER - 1, 2**252, *range(2, 50)]
    points = signing.encoded([signing.by_table(n, signing.base_table()) for n in scalars])
    signing.base_sums()
    monkeypatch.setattr(signing, "by_table", None)
    monkeypatch.setattr(signing, "public_of", lambda seed: public)
    assert signing.signatures(seed, messages) == want and signing.base_multiples(scalars) == points
    pairs = [(m, s if i % 3 else want[i - 1]) for i, (m, s) in enumerate(zip(messages, want, strict=True))]
    assert signing.verified(public, pairs) == [i % 3 > 0 for i in range(300)]


def test_limbs_against_whole_numbers():
    rng = random.Random(5)
    values = [0, 1, 18, 19, signing.P - 1, signing.P, signing.P + 18, 2**255 - 1, *(rng.getrandbits(255) for _ in range(100))]
    x = fields.limbs(values)
    apart = x - x[:, ::-1]
    whole = [fields.number(x[:, i]) for i in range(len(values))]
    assert whole == [v % signing.P for v in values]
    made = fields.product(3 * x, 2 * apart)
    assert [fields.number(made[:, i]) for i in range(len(values))] == [6 * a * (a - b) % signing.P for a, b in zip(whole, whole[::-1], strict=True)]
    ends = np.array([[3 * (fields.MASK + 1)] * fields.LIMBS, [-3 * (fields.MASK + 1)] * fields.LIMBS]).T
    made = fields.product(ends, ends[:, ::-1])
    assert [fields.number(made[:, i]) for i in (0, 1)] == [fields.number(ends[:, 0]) * fields.number(ends[:, 1]) % signing.P] * 2 and abs(made).max() < 1.01 * fields.MASK
    some = [v for v in values if v % signing.P]
    inverse = fields.inverses(fields.limbs(some))
    assert all(fields.number(inverse[:, i]) * v % signing.P == 1 for i, v in enumerate(some))
    for signs in (x, -x):
        assert [int.from_bytes(b.tobytes(), "little") & (1 << 255) - 1 for b in fields.encoded(signs, signs)] == [fields.number(signs[:, i]) for i in range(len(values))]


def test_lines_are_signed_once(spark):
    """A filter on the lines that signatures are in does not have them made again."""
    seed = bytes(32)
    who = signing.key_id(signing.public_of(seed))
    log = audit.signed(spark.range(20).select(F.col("id").alias("log"), F.col("id").alias("seq"), F.lit(who).alias("signing_key_id")), {who: seed})
    lines = audit.parsed_lines(log.select("log", "seq", F.to_json(F.struct("signature", "prev_hash", "entry_hash")).alias("raw")))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    # signatures and claims
    assert plan.count("ArrowEvalPython") == 2 and lines.where("signature is not null").count() == 20


def test_keys(tmp_path, spark):
    path = str(tmp_path / "keys" / "log.pem")
    who = signing.save_keypair(path)
    assert stat.S_IMODE(os.stat(path).st_mode) == 0o600
    got, seed = signing.load_key(path)
    public = signing.public_bytes((tmp_path / "keys" / "log.pub").read_text())
    assert got == who == signing.key_id(public) and public == signing.public_of(seed)
    assert who == "fingerprint:" + hashlib.sha256(bytes.fromhex("302a300506032b6570032100") + public).hexdigest()
    os.chmod(path, 0o604)
    with pytest.warns(UserWarning, match="read by others"):
        signing.load_key(path)
    with pytest.raises(FileNotFoundError):
        signing.load_key(str(tmp_path / "none.pem"))
    (tmp_path / "bad.pem").write_text("no key")
    with pytest.raises(ValueError):
        signing.load_key(str(tmp_path / "bad.pem"))
    assert [signing.public_bytes(x) for x in (None, "", "x", signing.private_pem(seed), "-----BEGIN PUBLIC KEY-----\nAAAA\n-----END PUBLIC KEY-----")] == [None] * 5
    registry = str(tmp_path / "registry.json")
    files.add_keys(spark, registry, audit.registry_rows(spark, [public], "2024-01-01T00:00:00Z"))
    files.add_keys(spark, registry, audit.registry_rows(spark, [signing.public_of(bytes(32))], "2024-02-01T00:00:00Z"))
    assert [r.signing_key_id for r in files.read_keys(spark, registry).collect()] == [who, signing.key_id(signing.public_of(bytes(32)))]
    assert json.loads((tmp_path / "registry.json").read_text())["keys"][0]["public_key_pem"] == signing.public_pem(public)


def test_signed_log(spark):
    seeds = {signing.key_id(signing.public_of(bytes([k] * 32))): bytes([k] * 32) for k in (1, 2)}
    a, b = seeds
    log = spark.createDataFrame([(1, i, f"page-{i}", [a, b, None, "fingerprint:other"][i % 4]) for i in range(40)], "log long, seq long, page string, signing_key_id string")
    rows = audit.signed(log, seeds).collect()
    assert [r.signature is None for r in sorted(rows, key=lambda r: r.seq)] == [False, False, True, True] * 10
    lines = []
    for r in sorted(rows, key=lambda r: r.seq):
        e = {c: r[c] for c in ("page", "alg", "signing_key_id", "prev_hash", "entry_hash", "signature")}
        if r.seq == 4:
            e["signature"] = rows[0].signature if rows[0].seq != 4 else rows[1].signature  # of another entry
        if r.seq == 5:
            e["signing_key_id"] = a  # relabelled: part of the hash
        if r.seq == 8:
            e["signature"] = "????"
        lines.append((1, r.seq, json.dumps(e)))
    raw = spark.createDataFrame(lines, "log long, seq long, raw string")
    keys = audit.registry_rows(spark, [signing.public_of(seeds[a])], "t")
    got = {r.seq: r for r in audit.verify(raw, keys=keys).collect()}
    assert [got[i].signed for i in range(9)] == [True, False, False, False, False, False, False, False, False]
    assert got[4].reasons == got[8].reasons == ["signature verification failed"] and got[1].reasons == ["unknown signing key"] and got[5].reasons == ["tampered"] and got[2].reasons == [] and got[2].unsigned
    assert sum(r.signed for r in got.values()) == 8 and all(r.valid for i, r in got.items() if i != 5)
    # a key that is no key, and no keys at all
    bad = spark.createDataFrame([(a, "nonsense")], "signing_key_id string, public_key_pem string")
    assert not any(r.signed for r in audit.verify(raw, keys=bad).collect()) and not any(r.signed for r in audit.verify(raw).collect())


def test_canonical_json(spark):
    cases = {
        '{"b":1,"a":2,"a":3}': '{"a":3,"b":1}', '{"x":1e3}': '{"x":1000}', '{"x":1e21}': '{"x":1e+21}', '{"x":123456789012345678901}': '{"x":123456789012345680000}', '{"x":-0}': '{"x":0}', '{"x":1e999}': '{"x":null}', '{"x":0.000001,"y":1e-7}': '{"x":0.000001,"y":1e-7}',
        '{"x":"\\u001F\\u0008\\/\\ud800"}': '{"x":"\\u001f\\b/\\ud800"}', '{"\\ud83d\\ude00":1,"￮":2}': '{"\U0001f600":1,"￮":2}', '{"x":[true,null,{}, []]}': '{"x":[true,null,{},[]]}', '{"x":9007199254740993}': '{"x":9007199254740992}',
        "[1]": None, "3": None, "null": None, '{"x":NaN}': None, "{": None, "": None, '{"x":"\t"}': None, "{'x':1}": None, '{"x":01}': None, '{"x":1}}': None, "[" * 100000: None,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "raw string")
    got = {r.raw: r.c for r in df.select("raw", audit.canonical_json(F.col("raw")).alias("c")).collect()}
    assert got == cases | {None: None}
    for x in (5e-324, 1.7976931348623157e308, 0.1 + 0.2, 100.0, 1e-6, 1.5e300, 123456.789, 4.35, 2.0**60):
        assert float(jsontext.number_text(x)) == x and float(jsontext.number_text(-x)) == -x


def test_log_of_several_files(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text("".join(f'{{"n":{i}}}\n' for i in range(50000)))
    (tmp_path / "a.jsonl").write_text('{"n":-2}\n\n{"n":-1}\n')
    (tmp_path / "c.jsonl").write_text('{"n":50000}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = [r.raw for r in files.read_log(spark, str(tmp_path)).orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f'{{"n":{i}}}' for i in range(-2, 50001)]


def test_lines_are_read_once_and_checked_by_all_tasks(spark):
    log = audit.chain(spark.range(50).select((F.col("id") % 3).alias("log"), F.col("id").alias("seq"), F.lit("fingerprint:a").alias("signing_key_id")))
    raw = log.select("log", "seq", audit.lines(log, ["signing_key_id"]).alias("raw"))
    keys = audit.registry_rows(spark, [signing.public_of(bytes(32))], "t")
    found = audit.verify(raw, keys=keys, width=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # only the signatures are left for Python, and no exchange gathers the entries of a key
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan and "BroadcastHashJoin [signing_key_id" in plan
    assert all(r.valid and not r.reasons for r in found.collect()) and found.count() == 50
