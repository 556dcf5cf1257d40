"""BPE, SimHash, quality, HTML, WARC, media and embeddings against plain Python."""

import hashlib
import itertools
import os
import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from docloom.llm import bpe, embeddings, html, media, quality, simhash, warc

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_bpe_is_the_library(spark, tiny):
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(PATH), random.Random(1)
    odd = [None, "", "  \n", "don't I'LL 're's x's", "é a\u0301 \u0301x  y\u3000中文字 a\x1cb \x85z", "<|endoftext|>a<|startoftext|> <| endoftext|>", "İstanbul ΣΑΣ ς", "x\x00y\u200b\ufeff!!!???...", "12a3 ½ ②", "🎉👩‍👩‍👧 a", "ﬁ Å", "a" * 3000, "ab." * 3000]
    odd += ["".join(rng.choice("ab'sStT  \n\té中0189.,!?<|>\x1fİßſK\u0301") for _ in range(50)) for _ in range(200)]
    rows = [(i, t, 1) for i, t in enumerate(odd + odd[:3])] + [(1000 + r["doc_id"], r["text"], 1) for r in pq.read_table(f"{tiny}/documents.parquet").to_pylist()]
    got = bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t, _ in rows}
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(h >> i & 1 for h in hs) > len(hs)) << i for i in range(64))


def test_simhash_against_all_pairs(spark, tiny):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{tiny}/documents.parquet").to_pylist()]
    long = " ".join(f"w{i}" for i in range(900)).split()
    rows += [(1000 + k, " ".join([*long[: k * 7], "changed", *long[k * 7 + 1 :]])) for k in range(30)]
    rows += [(2000, None), (2001, ""), (2002, " \n"), (2003, "One two"), (2003, "one TWO"), (2004, "x " * 100000), (None, "One two"), (None, "alone here")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(simhash.fingerprints(df)).collect()
    fps = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3 and label[i] != label[j]:
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label, strict=True):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    want = sorted((str(d), f, str(least.get(x))) for (d, _), f, x in zip(rows, fps, label, strict=True))
    assert sorted((str(r.key), r.fp % 2**64, str(r.component_id)) for r in got) == want
    assert len({least.get(x) for (d, _), x in zip(rows, label, strict=True) if d and 1000 <= d < 1030}) < 30


def test_simhash_tiles_agree(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << k) for k in (0, 9, 33, 62)), *(base ^ np.uint64(7 << k) for k in (5, 40)), rng.integers(0, 2**63, 500, dtype=np.uint64)]))
    label = simhash.linked_groups(fps, None, 3)
    brute = np.arange(len(fps))
    for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3), strict=True):
        brute[brute == max(brute[i], brute[j])] = min(brute[i], brute[j])
    assert (label == brute).all()
    distinct = spark.createDataFrame([(int(x.view(np.int64)), i) for i, x in enumerate(fps)], "fp long, rep long")
    links = simhash.tile_links(distinct, 3, tile_rows=7).collect()
    joined = np.arange(len(fps))
    for r in links:
        joined[joined == max(joined[r.src], joined[r.dst])] = min(joined[r.src], joined[r.dst])
    assert (joined == brute).all()


def test_near_copies_leave_one(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(400)]
    near = [[*base] for _ in range(120)]
    for k, t in enumerate(near):
        t[(k * 3) % 400] = word()
    clean = [" ".join(word() for _ in range(n)) for n in (3, 40, 400, 400, 500)] + [" ".join(base[:200] + [word() for _ in range(300)])]
    rows = [(10 + k, " ".join(t), None) for k, t in enumerate(near)] + [(500 + k, t, "x") for k, t in enumerate(clean)] + [(3, None, None), (4, "", "e"), (9, "a b", "q"), (9, "a b", "q"), (None, "lonely", "z")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, size string"))
    assert got.columns == ["doc_id", "text", "size"]
    assert sorted((r.doc_id or -1) for r in got.collect()) == [-1, 3, 9, 10, 500, 501, 502, 503, 504, 505]
    assert simhash.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_copies_by_exact_similarity(spark):
    """Pairs about the bound of 0.8 against their Jaccard similarity."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    rows, linked = [], []
    for k in range(300):
        a = [word() for _ in range(104)]
        b = [*a]
        b[100 - k % 20 :] = [word() for _ in range(4 + k % 20)]
        x, y = ({" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        linked.append(len(x & y) >= 0.8 * len(x | y))
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 50 < sum(linked) < 250 and all(2 * k in got for k in range(300))
    assert not any(2 * k + 1 not in got for k in range(300) if not linked[k])
    assert sum(2 * k + 1 not in got for k in range(300) if linked[k]) >= 0.99 * sum(linked)


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    n = np.array([1, 4, 3])
    emit, trans = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pair, _ = quality.forward_backward(n, emit, trans)
    at, want, moves = 0, [], np.zeros((2, 2))
    for k in n:
        e, total, sums, own = emit[at : at + k], 0.0, np.zeros(k), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(k)):
            p = np.exp(sum(e[i] * y[i] for i in range(k)) + sum(trans[y[i], y[i + 1]] for i in range(k - 1)))
            total += p
            sums += p * np.array(y)
            for i in range(k - 1):
                own[y[i], y[i + 1]] += p
        want += list(sums / total)
        moves += own / total
        at += k
    assert np.allclose(good, want) and np.allclose(pair, moves)


def test_quality_held_out(spark):
    at = "/root/testdata/sf0.01"
    got = quality.op2_quality(spark, at).toPandas()
    labels = pq.read_table(f"{at}/labels.parquet").to_pandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all() and got.score.between(0, 1).all() and len(got) == 1000
    m = got[got.held_out].merge(labels, on="doc_id")
    assert (m.predicted == m.quality).mean() > 0.95


def test_quality_odd_input(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "", 1), (3, "a\n" * 5000, 1), (4, "fine text of a kind. " * 9, 1), (4, "fine text of a kind. " * 9, 1), (5, "x" * 300000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(4, 1), (4, 0), (3, None), (None, 1), (1, 0), (77, 1)], "doc_id long, quality int")
    model = quality.train(docs.select("doc_id", "text"), labels)
    got = quality.score(docs.select("doc_id", "text"), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    none = quality.train(docs, labels.limit(0))
    assert {r.s for r in quality.score(docs, none, out="s").collect()} == {0.5}
    assert quality.score(docs.limit(0), none, out="s").count() == 0


def test_html_rules(spark):
    text = "This is the text of the article, and it has a lot of the words that are in all of the texts, so that it is found to be good by the rules that we have. It is also long enough to be the main text of the page, as one would think."
    page = f"""<html><head><title>No</title><style>p {{}}</style></head><body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav>
    <div class="cookie-notice">{text}</div><div class="sidebar"><p>{text}</p></div><div id=content><h2>The&nbsp; head &amp; more</h2><p>{text}<p>Short one.<br>Next
    line.</div><section id="comments"><p>{text}</p></section><form>{text}</form><aside>{text}</aside><script>if (a<b) "</p>"</script><footer>&copy; 2020</footer>"""
    assert html.main_text(page) == f"The head & more\n{text}\nShort one. Next line."
    rows = [(1, page), (2, None), (3, ""), (4, "<"), (5, "<!-- open"), (6, "<p>a &lt; b</p>"), (6, "<p>a &lt; b</p>"), (None, "<div class=ad>x"), (7, f"<article><p>{'long words ' * 30000}")]
    got = html.extract(spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, html string, k string, n_chars int")).collect()
    assert [r.text for r in got if r.page_id == 6] == ["a < b"] * 2 and [len(r.text) for r in got if r.page_id in (2, 3, 5, None)] == [0] * 4 and len(got) == len(rows)
    assert next(len(r.text) for r in got if r.page_id == 7) == 11 * 30000 - 1


def test_html_self_closed_and_unclosed_tags():
    assert html.main_text("<p>a <svg class=i/> b</p><p>c</p>") == "a b\nc"
    assert html.main_text('<p>a <svg viewBox="0 0"><path d="M0"/><text>label</text></svg> b</p><p>c</p>') == "a b\nc"
    assert html.main_text("<p>a <svg><path> b</p><p>c</p>") == "a b\nc"
    assert html.main_text("<p>a <svg><path> b</p><p>c <svg><text>label</text></svg> d</p>") == "a b\nc d"
    assert html.main_text("<p>x <math><mi>y</mi></math> <object data=z/> <canvas>drawn</canvas> w</p><p>c <object>read on</p>") == "x y drawn w\nc read on"
    assert html.main_text("<p>a</p><script src=x/>no</script><p>b</p><style>no") == "a\nb"


def test_html_classes_of_wrappers():
    text = "This is the text of the article, and it has a lot of the words that are in all of the texts, so that it is found to be good by the rules that we have. It is also long enough to be the main text of the page, as one would think."
    other = text.replace("article", "comment")
    want = f"The head\n{text}\n{text}"
    inner = f"<div><h1>The head</h1><p>{text}</p><p>{text}</p></div>"
    bad = f'<div class="sidebar"><p>{other}</p></div>'
    for start in ('<body class="no-sidebar has-header">', "<html class=header><body id=widget>", '<div id=page class="with-sidebar">', '<div class="layout social"><div class="reader">'):
        assert html.main_text(f"{start}{inner}{bad}") == want
    assert html.main_text(f'<body><p>{text}</p><div class="comments">{f"<p>{other}</p>" * 9}</div>') == text
    assert html.main_text(f'<body><div class="widget"><p>{text}</p></div><footer>{text}</footer>') == ""
    assert html.main_text(f'<body><div class="widget"><p>{text}</p><p>{text}</p></div><footer>End</footer>') == f"{text}\n{text}"


def test_html_pages(spark, tiny):
    import html as h
    import re

    for r in html.op3_html(spark, tiny).join(spark.read.parquet(f"{tiny}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inside = re.split(r"<article>|</article>", r.html)[1]
        blocks = [" ".join(h.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", "<title>T</title><p>One &amp;\n two<p>Three<script>x</script>", 1), (2, None, None, 1), (None, "u", "", 1), (1, "http://a.b/", "<title>T</title><p>One &amp;\n two<p>Three<script>x</script>", 1)], "page_id long, url string, html string, record int")
    sent = warc.responses(pages)
    got = warc.derivatives(sent, ["page_id"]).collect()
    assert len(got) == 8
    source = {r.page_id: r.warc for r in sent.collect()}
    for r in got:
        headers, block = warc.parse(r.record)
        own, body = warc.parse(source[r.page_id])
        assert warc.get(headers, "WARC-Refers-To") == warc.get(own, "WARC-Record-ID") == r.refers_to and block.decode() == r.block
        assert warc.get(headers, "WARC-Block-Digest") == warc.digest(block) and r.source_payload_digest == warc.get(own, "WARC-Payload-Digest") == warc.digest(warc.http(body)[2])
        other = next(x for x in got if x.page_id == r.page_id and x.type != r.type)
        assert warc.get(headers, "WARC-Concurrent-To") == other.record_id
    assert {r.block for r in got if r.page_id == 1 and r.type == "conversion"} == {"T\nOne & two\nThree"}
    assert "source-header-Content-Type: text/html; charset=utf-8" in next(r.block for r in got if r.page_id == 1 and r.type == "metadata")
    odd = spark.createDataFrame([(1, b"junk"), (2, None), (3, warc.record([("WARC-Type", "request")], b"x")), (4, warc.record([("WARC-Type", "response")], b"body")[:-6]), (5, warc.record([("warc-type", "response")], b"just payload"))], "page_id long, warc binary")
    found = {(r.page_id, r.type): r for r in warc.derivatives(odd, ["page_id"]).collect()}
    assert set(found) == {(1, "error"), (4, "error"), (5, "metadata"), (5, "conversion")} and found[5, "conversion"].block == "just payload"


def test_media_round_trip():
    for n in [0, 1, 64, 163, 164, 165, 183, 184, 185, 348, 349, 350, 351, 32767, 32768, 32769, 100000, *(random.Random(4).randrange(40000) for _ in range(60))]:
        payload = os.urandom(n)
        stream = media.mux_bytes(payload)
        d = media.demux_bytes(stream)
        assert d.payload == payload and len(stream) % 188 == 0 and (d.gaps, d.lost_bytes, d.bad_tables, d.programs, d.streams) == (0, 0, 0, 1, 1)
        assert [u[1] for u in d.units] == [3600 * i for i in range(len(d.units))] and all(u[4] and not u[5] for u in d.units)


def test_media_damage():
    stream = media.mux_bytes(os.urandom(40000))
    cut = media.demux_bytes(stream[: 188 * 5] + stream[188 * 6 :])
    assert cut.gaps == 1 and [u[5] for u in cut.units] == [True, False]
    twice = media.demux_bytes(stream[: 188 * 4] + stream[188 * 3 : 188 * 4] + stream[188 * 4 :])
    assert twice.duplicates == 1 and twice.payload == media.demux_bytes(stream).payload
    assert media.demux_bytes(b"x" + stream).payload == media.demux_bytes(stream).payload
    assert media.demux_bytes(os.urandom(999)).payload == b"" and media.demux_bytes(b"").packets == 0
    bad = bytearray(stream)
    bad[10] ^= 1
    assert media.demux_bytes(bytes(bad)).bad_tables == 1


def test_media_query(spark, tmp_path):
    texts = [None, "", "é" * 32, "a" * 63, "b" * 64, "c" * 65, "long " * 30000, "", "tie"]
    pd.DataFrame({"doc_id": [*range(8), None], "text": texts, "media": 1}).astype({"doc_id": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    for r in media.op9_media(spark, str(tmp_path)).collect():
        raw = (texts[r.doc_id if r.doc_id is not None else 8] or "").encode()
        payload = raw + bytes(64 if not raw else -len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.mux_bytes(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_embeddings_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(embeddings, "TILE_ROWS", 64)
    centre = rng.normal(size=(30, 16))
    vecs = [c + rng.normal(size=16) * s for c in centre for s in (0.05, 0.1, 0.2, 0.3) for _ in range(4)]
    vecs += [centre[0] + rng.normal(size=16) * 0.02 for _ in range(300)] + [centre[1]] * 40 + [centre[2] * 3]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vecs)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    rows += [(5000 + i, v) for i, v in enumerate(odd)] + [(None, rows[0][1])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, n int")
    got = {r.id: r for r in embeddings.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    x = np.array([r[1] for r in rows[: len(vecs)]], np.float32).astype(float)
    length = np.sqrt((x * x).sum(1))
    link = x @ x.T / (length[:, None] * length) >= 0.95
    np.fill_diagonal(link, False)
    found, want = np.array([got[i].n_links for i in range(len(vecs))]), link.sum(1)
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum() and found[-2] >= 39
    for i in range(5000, 5006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[5007].component_id == 5006 and got[5006].n_links == 1 and got[None].n_links == 0 and got[None].kept is False
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert all(r.kept == (r.id == r.component_id) for i, r in got.items() if i is not None)
    assert got[0].component_id == 0 and {got[i].component_id for i in range(480, 780)} == {0}


def test_pipeline_stages(spark, tiny):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, frames[-1], tiny).persist()
        frames.append(out)
    assert all(f.columns == columns for f in frames[1:-1])
    sizes = [f.count() for f in frames]
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[4] == sizes[5]
    kept = {r.doc_id for r in frames[1].select("doc_id").collect()}
    score = {r.doc_id: r.score for r in quality.op2_quality(spark, tiny).collect()}
    assert kept == {i for i, s in score.items() if s >= 0.5}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tiny).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "words of a kind and more of it", None, None, None)], docs.schema)
    assert set(corpus_pipeline.good_quality(spark, nulls, tiny).collect()) <= set(nulls.collect())
    assert corpus_pipeline.without_repeated_lines(spark, nulls, tiny).count() == 4
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, nulls, tiny).collect()) == [1, 2]
    assert {r.doc_id for r in corpus_pipeline.mixed(spark, nulls, tiny).collect()} == {2}
    assert sorted(r.n_tokens > 0 for r in corpus_pipeline.encoded(spark, nulls, tiny).collect()) == [False, False, False, True]
    assert frames[3].where(F.col("n_chars") != F.char_length("text")).count() == 0
