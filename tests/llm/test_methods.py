"""The methods themselves against plain readers, parsers and counting written here."""

import base64
import collections
import hashlib
import html as h
import itertools
import random
import re
import types

import pyarrow.parquet as pq
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docloom.llm import bpe, common, html, media, mixing, quality, simhash, urls, warc


def records(data):
    """A reader of records by their lengths alone."""
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines)
        n = int(fields["Content-Length"])
        assert version == "WARC/1.1" and rest[n : n + 4] == b"\r\n\r\n"
        yield fields, rest[:n]
        data = rest[n + 4 :]


def sha1(block):
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def test_warc_by_another_reader(spark, tiny):
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    raw = {r.page_id: r for r in pages.collect()}
    sent = warc.responses(pages)
    source = {r.page_id: list(records(r.warc)) for r in sent.collect()}
    ids = set()
    for r in warc.derivatives(sent, ["page_id"]).collect():
        ((fields, block),) = records(r.record)
        ((own, response),) = source[r.page_id]
        payload = response.partition(b"\r\n\r\n")[2]
        assert payload == (raw[r.page_id].html or "").encode() and own["WARC-Block-Digest"] == sha1(response) and own["WARC-Payload-Digest"] == sha1(payload)
        assert fields["WARC-Type"] == r.type and fields["WARC-Refers-To"] == own["WARC-Record-ID"] and fields["WARC-Target-URI"] == raw[r.page_id].url and fields["WARC-Block-Digest"] == sha1(block)
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"])
        ids.add(fields["WARC-Record-ID"])
        if r.type == "metadata":
            told = dict(line.split(": ", 1) for line in block.decode().split("\r\n") if line)
            assert told["source-payload-digest"] == sha1(payload) and told["source-header-Content-Length"] == str(len(payload)) and fields["Content-Type"] == "application/warc-fields"
        else:
            page = re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", " ", payload.decode()).replace("\n", " ")
            words = h.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:a|b|i|em|span|strong)\b[^>]*>", "", page))).split()
            assert block.decode().split() == words
    assert len(ids) == 2 * len(raw)
    clash = warc.derivatives(sent.withColumnRenamed("page_id", "type"), ["type"])
    assert clash.columns[:2] == ["_type", "type"] and clash.count() == 2 * len(raw)


def packets(stream):
    """A parser of transport packets: (pid, starts, counter, adaptation, payload)."""
    assert len(stream) % 188 == 0
    for i in range(0, len(stream), 188):
        p = stream[i : i + 188]
        assert p[0] == 0x47
        field = p[5 : 5 + p[4]] if p[3] & 0x20 else b""
        start = 5 + p[4] if p[3] & 0x20 else 4
        yield (p[1] & 31) << 8 | p[2], bool(p[1] & 64), p[3] & 15, field, p[start:] if p[3] & 0x10 else b""


def crc(data):
    c = 0xFFFFFFFF
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c >> 31 else 0)) & 0xFFFFFFFF
    return c


def test_media_by_another_parser():
    rng = random.Random(3)
    for n in (0, 64, 4096, 32768, 70_000):
        payload = rng.randbytes(n)
        counters, units, tables = {}, [], set()
        for pid, starts, counter, field, body in packets(media.mux_bytes(payload)):
            assert counter == counters.get(pid, -1) + 1 & 15
            counters[pid] = counter
            if pid in (0, 0x1000):
                section = body[1 : 4 + ((body[2] & 15) << 8 | body[3])]
                assert crc(section) == 0
                tables.add((pid, section[0], section[-6] & 31 if pid else section[10] & 31))
            elif starts:
                assert field[0] & 0x40  # random access
                pts = (body[9] >> 1 & 7) << 30 | body[10] << 22 | body[11] >> 1 << 15 | body[12] << 7 | body[13] >> 1
                units.append([pts, body[14:]])
            else:
                units[-1][1] += body
        assert b"".join(u[1] for u in units) == payload and [u[0] for u in units] == [3600 * i for i in range(len(units))] and {t[:2] for t in tables} == {(0, 0), (0x1000, 2)}


def test_media_out_of_step(spark):
    stream = media.mux_bytes(random.Random(1).randbytes(5000))
    whole = media.demux_bytes(stream).payload
    late = media.demux_bytes(b"\x47" + stream)
    assert late.payload == whole and late.lost_bytes == 1
    headless = b"".join(stream[i : i + 188] for i in range(0, len(stream), 188) if (stream[i + 1] & 31) << 8 | stream[i + 2] not in (0, 0x1000))
    got = media.demux_bytes(headless)
    assert got.payload == b"" and got.lost_bytes > 5000
    df = spark.createDataFrame([(b"abc", 1, 2), (None, 1, 2)], "payload binary, media int, stream int")
    rows = media.demux(media.mux(df, "payload")).collect()
    assert [r.stream and bytes(r.stream.payload) for r in rows] == [b"abc", None] and rows[0].stream.units[0].random_access


def test_rules_by_counting(spark):
    """Mined rules and verdicts against all combinations of tokens."""
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        items = [t for t, p in zip("abcde", (0.5, 0.4, 0.3, 0.5, 0.2), strict=True) if rng.random() < p] or ["f"]
        items += ["a2", "a3"] if "a" in items else []  # always with a
        rows.append((items, "block" if {"a", "b"} <= set(items) and rng.random() < 0.95 or rng.random() < 0.1 else "allow"))
    df = spark.createDataFrame(rows, "items array<string>, label string")
    rules = urls.mine(df, support=0.02, confidence=0.6).collect()
    count = lambda need, label=None: sum(set(need) <= set(i) and label in (None, x) for i, x in rows)
    stands = {"a": "a", "a2": "a", "a3": "a"}
    seen = {tuple(sorted(c)) for n in range(1, 6) for c in itertools.combinations("abcdef", n)}
    total = collections.Counter(x for _, x in rows)

    def end(n, of, side, z=1.96):
        p = n / of
        return (p + z * z / 2 / of + side * z * (p * (1 - p) / of + z * z / 4 / of / of) ** 0.5) / (1 + z * z / of)

    def rated(c, label):
        other = "allow" if label == "block" else "block"
        low = end(count(c, label), total[label], -1)
        # FP-growth has no count of a combination with the other label below the support
        few = count(c, other) if count(c, other) >= 6 else min(5, count(c) - count(c, label))
        return low / (low + end(few, total[other], 1))

    want = {(c, label): rated(c, label) for c in seen for label in ("allow", "block") if count(c, label) >= 0.02 * len(rows) and rated(c, label) >= 0.6}
    kept = {k: v for k, v in want.items() if not any((tuple(x for x in k[0] if x != t), k[1]) in want and want[tuple(x for x in k[0] if x != t), k[1]] >= v for t in k[0])}
    got = {(tuple(sorted(stands.get(t, t) for t in r.items)), r.label): r.confidence for r in [r.asDict() and types.SimpleNamespace(**r.asDict()) for r in rules]}
    assert set(got) == set(kept) and all(abs(got[k] - kept[k]) < 1e-9 for k in kept) and kept
    urls_of = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "row long, items array<string>")
    best = {r.row: (r.label, r.confidence) for r in urls.match(urls_of, urls.mine(df, support=0.02, confidence=0.6)).collect()}
    for i, (items, _) in enumerate(rows):
        fits = [(v, label) for (need, label), v in kept.items() if set(need) <= set(items)]
        assert (i in best) == bool(fits) and (not fits or abs(best[i][1] - max(fits)[0]) < 1e-9)


def test_rules_of_long_paths(spark):
    rows = [([f"p:{i}" for i in range(40)], "block")] * 30 + [(["p:x"], "allow")] * 30
    rules = urls.mine(spark.createDataFrame(rows, "items array<string>, label string")).collect()
    assert {(len(r["items"]), r.label) for r in rules} == {(1, "block"), (1, "allow")}


def test_mined_rules_carry_the_list_over(spark):
    pages = [(i, f"http://s{i % 9}.com/en/{i}") for i in range(60)] + [(100 + i, f"http://example.com/en/7{i}") for i in range(60)] + [(900, "http://other.test/en/9"), (901, "http://nothing.known/zz")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert got[0].verdict == "block" and got[100].verdict == "allow" and got[901].verdict == "allow" and got[901].confidence is None and got[900].rule is None


def test_shards_are_drawn(spark):
    rows = [(i, f"s{i % 3}", "w " * (40 + i % 50)) for i in range(900)] + [(5000, "tiny", "one two three")]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block_words=8, shard_slots=64)
    counts = collections.defaultdict(dict)
    for r in mix.shards().collect():
        counts[r.shard][r.no] = r.slots
    plan = {r.no: r for r in mix.sources.collect()}
    total = sum(p.takes for p in plan.values())
    drawn = collections.Counter()
    for c in counts.values():
        drawn.update(c)
    assert all(drawn[no] == p.takes for no, p in plan.items())
    # a multinomial count scatters by n p (1 - p); a fixed share would not
    big = max(plan.values(), key=lambda p: p.takes)
    p, full = big.takes / total, [c.get(big.no, 0) for c in counts.values() if sum(c.values()) == 64]
    scatter = sum((x - 64 * p) ** 2 for x in full) / len(full)
    assert len(full) > 50 and 0.6 < scatter / (64 * p * (1 - p)) < 1.6
    taken = {r.doc_id: r for r in mix.taken().collect()}
    assert all(r.taken <= 2 * r.size for r in taken.values())
    for no, p in plan.items():
        assert abs(sum(r.taken for r in taken.values() if r.no == no) - p.target) <= 8 + 0.02 * p.target


def test_html_without_article_tags(spark, tiny):
    """The same pages with div in place of article give the plain text of what was the article."""
    for r in spark.read.parquet(f"{tiny}/pages.parquet").collect():
        inside = re.split(r"<article>|</article>", r.html)[1]
        blocks = [" ".join(h.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert html.main_text(re.sub(r"<(/?)article>", r"<\1div>", r.html)) == "\n".join(b for b in blocks if b)
    odd = html.extract(spark.createDataFrame([(1, "<p>a", "old", 2), (2, None, "old", 2)], "page_id long, html string, text string, n_chars int"))
    assert [(r.page_id, r.text, r.n_chars) for r in odd.collect()] == [(1, "a", 2), (2, "", 2)]


def test_decoding_takes_ids_alone(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    sent = [library.encode(t, add_special_tokens=False).ids for t in ("Plain words, 12!", "", "é <|endoftext|>")]
    rows = [(i, b"".join(x.to_bytes(4, "little") for x in ids)) for i, ids in enumerate(sent)] + [(9, None), (10, b"abc"), (11, b"\xff\xff\xff\x7f")]
    got = {r.doc_id: r.decoded for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids binary"), path).collect()}
    assert [got[i] for i in range(3)] == [library.decode(ids, skip_special_tokens=False) for ids in sent] and got[9] is got[10] is got[11] is None
    one = bpe.encoder(path)
    one.held = bpe.CACHE_BYTES + 1  # a full cache is emptied and filled again
    assert one.encode_batch(["again and again"])[0] == b"".join(x.to_bytes(4, "little") for x in library.encode("again and again", add_special_tokens=False).ids)


def test_simhash_keys_of_any_type(spark):
    rows = [("b", "one two three"), ("a", "one two three"), (None, "one two three"), ("z", "other words here")]
    got = sorted((str(r.key), r.component_id) for r in simhash.near_duplicates(simhash.fingerprints(spark.createDataFrame(rows, "doc_id string, text string"))).collect())
    assert got == [("None", "a"), ("a", "a"), ("b", "a"), ("z", "z")]
    kept = simhash.keep_one(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id string, text string, key int, kept int")).collect()
    assert sorted((r.doc_id, r.key, r.kept) for r in kept) == [("a", 1, 2), ("z", 1, 2)]


def test_near_copies_against_brute_force(spark):
    at = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{at}/documents.parquet").to_pylist()[:500]]
    sets = {}
    for d, t in rows:
        words = (t or "").encode().lower().split()
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    by = collections.defaultdict(set)
    for d, s in sets.items():
        for x in s:
            by[x].add(d)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    shared = collections.Counter(p for ds in by.values() if len(ds) < 60 for p in itertools.combinations(sorted(ds), 2))
    for (a, b), _ in shared.items():
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    want = {d for d in sets if find(d) == d}
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = set(sets) - want
    assert want <= got and (not gone or len(gone - got) >= 0.9 * len(gone))


def test_scores_of_a_clashing_column(spark):
    df = spark.createDataFrame([(1, "Fine words of a text.", "old"), (2, None, "old")], "doc_id long, text string, score string")
    model = quality.train(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r.score for r in quality.score(df, model).collect()] == [0.5, 0.5] and df.where(quality.scorer(model)(F.col("text")) >= 0.6).count() == 0


def test_shared_folder_of_a_cluster():
    empty = types.SimpleNamespace(isEmpty=lambda: True)
    sc = types.SimpleNamespace(master="spark://host:7077", _jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: empty)))
    session = types.SimpleNamespace(sparkContext=sc, conf=types.SimpleNamespace(get=lambda k, d: d))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(session)


def test_scratch_drops_tables(spark):
    scratch = common.Scratch(spark)
    one, two = scratch.table(spark.range(5)), scratch.table(spark.range(3))
    assert one.count() == 5 and two.count() == 3
    scratch.drop(one)
    assert two.count() == 3 and len(scratch.paths) == 1
