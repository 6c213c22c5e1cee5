"""The ten operators and the pipeline against brute force, and on awkward tables."""

import base64
import collections
import hashlib
import io
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from terrasift.llm import common, factorisation, html_text, katz, mixing, near_dups, packing, quality_rules, queries, sketches, toxicity, warc

WORD = regex.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target long, score double, kept string, label int, _row long, h long, fingerprint string"
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))


def awkward() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows; columns named as the operators' own."""
    rnd = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    rows = [(1, "", "en", "a", 0), (2, None, None, None, None), (3, LONG, "en", "a", len(LONG)), (4, " \t\n ", "de", "b", 4), (5, "one", "xx", "", 3), (None, "no id here at all", "en", "b", 17)]
    for i in range(10, 60):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(30, 200)))
        rows.append((i, text, rnd.choice(["en", "de", None]), rnd.choice(["a", "a", "b", "c", None]), len(text)))
    rows += [rows[10], rows[10], (100, rows[11][1], "en", "a", 1), (101, "naïve 😀 " * 30 + "<|endoftext|>", "en", "c", 1), (102, "a b c", "en", "c", 5), (103, "\x85 nbsp\xa0x \x1c y", "en", "c", 9), (104, "#### ** | <b>\nx\nx\n\n", "en", "c", 9)]
    return [(*r, "size", 7, 0.5, "kept", 3, 9, 8, "print") for r in rows]


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("edge"))
    spark.createDataFrame(awkward(), SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 10 == 0), "x") for i in range(10, 60)] + [(10, 1, 0, "x"), (None, 1, 1, "x"), (11, None, None, "x")], "doc_id long, quality int, toxic int, text string").write.parquet(f"{d}/labels.parquet")
    pages = [(1, "http://a/", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (0, None, None), (3, "", ""), (4, "http://c/", "<article>" + "<p>x &amp; y</p>" * 5000), (2, "http://b/", "<p>same</p>"), (None, "u", "<p>alone</p>"), (5, "u\r\nX: y", "a < b <3 <!-- open")]
    spark.createDataFrame([(*p, "t", 3) for p in pages], "page_id long, url string, html string, text string, refers_to long").write.parquet(f"{d}/pages.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, edge, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "labels", "pages"):
        spark.read.parquet(f"{edge}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


OPS = queries.queries()


@pytest.mark.parametrize("name", [n for n in OPS])
def test_awkward_table(spark, edge, name):
    got = OPS[name](spark, edge).toPandas()
    if name == "pipeline":
        assert len(got)
    else:
        table = "pages" if name in ("op6_warc", "op7_html_extraction") else "documents"
        assert len(got) == spark.read.parquet(f"{edge}/{table}.parquet").count() or name == "op4_packing"
    if "score" in got and name != "op3_katz":
        assert got["score"].between(0, 1).all()


@pytest.mark.parametrize("name", [n for n in OPS])
def test_empty_table(spark, empty, name):
    assert OPS[name](spark, empty).count() == 0


def docs_of(spark, d):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]


def both(spark, data, edge):
    return [data, edge]


def test_mixing(spark, data, edge):
    for d in (data, edge):
        docs = docs_of(spark, d)
        size = collections.defaultdict(int)
        for _, text, source in docs:
            size[source] += len(WORD.findall(text or ""))
        order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
        capped, target = set(), {}
        while True:
            free = [s for s in order if s not in capped]
            left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
            target = {s: 2 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in order}
            over = {s for s in free if target[s] > 2 * size[s]}
            if not over:
                break
            capped |= over
        got = OPS["op1_mixing"](spark, d).toPandas()
        again = OPS["op1_mixing"](spark, d).toPandas()
        assert sorted(map(str, got.itertuples(index=False))) == sorted(map(str, again.itertuples(index=False)))
        want = sorted((str(i), len(WORD.findall(t or "")), size[s], round(target[s], 4)) for i, t, s in docs)
        assert sorted((str(None if pd.isna(r.doc_id) else int(r.doc_id)), r.size_, r.source_size, round(r.target, 4)) for r in got.rename(columns={"size": "size_"}).itertuples()) == want
        assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] % got["size"].clip(lower=1) == 0).all()
    # On the larger of the two the words taken come near the targets.
    rows = mixing.mix(spark, common.read(spark, data, "documents"), ("doc_id", "source")).rows.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.max("size").alias("m")).toPandas()
    assert ((rows["t"] - rows["w"]).abs() <= rows["m"]).all()


def test_mix_is_ordered_and_follows_the_schedule(spark, data):
    docs = common.read(spark, data, "documents")
    m = mixing.mix(spark, docs, ("doc_id",))
    assert m.epochs().agg(F.sum("size")).first()[0] == m.rows.agg(F.sum("taken")).first()[0]
    p = [r["position"] for r in m.epochs().collect()]
    assert p == sorted(p) and 0 <= p[0] and p[-1] <= 1


def test_schedule_inverse(spark):
    for s in mixing.SCHEDULES:
        shares = [i / 20 for i in range(21)]
        got = [r[0] for r in spark.createDataFrame([(x,) for x in shares], "x double").select(mixing._inverse(F.col("x"), s)).collect()]
        for x, t in zip(shares, got, strict=True):
            area = sum((min(t, t1) - t0) * (a + (a + (b - a) * (min(t, t1) - t0) / (t1 - t0))) / 2 for (t0, a), (t1, b) in zip(s, s[1:], strict=False) if t > t0)
            assert area == pytest.approx(x * mixing.integral(s), abs=1e-9)


def test_toxicity_learns(spark, tmp_path):
    rnd = random.Random(3)
    plain = [f"{a}{b}{c}" for a in ("th", "er", "on", "an") for b in ("re", "st", "nd", "ti") for c in ("in", "es", "ou", "at")]
    rows, labels = [], []
    for i in range(700):
        toxic = i % 4 == 0
        w = [rnd.choice(plain) for _ in range(rnd.randint(40, 120))]
        for _ in range(4 if toxic else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(["wretched", "scoundrel", "imbecile"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = common.crc_mod(F.col("doc_id"), 4) == 2
    scorer = toxicity.train(spark, docs, lab, held)
    got = toxicity.score(docs, scorer).join(lab, "doc_id").where(held).toPandas()
    assert ((got["score"] >= 0.3) == (got["toxic"] == 1)).mean() > 0.95
    assert b"imbecile" in scorer.toxic and b"imbecile" not in scorer.ordinary
    # It is the two dictionaries that tell: with the ordinary one on both sides nothing is saved and nothing told apart.
    off = toxicity.Scorer(scorer.ordinary, scorer.ordinary, scorer.mean, scorer.scale, scorer.weights)
    blind = toxicity.score(docs, off).join(lab, "doc_id").where(held).toPandas()
    assert abs(blind.loc[blind["toxic"] == 1, "score"].mean() - blind.loc[blind["toxic"] == 0, "score"].mean()) < 0.02


def test_toxic_samples_are_toxic_documents_words():
    assert toxicity.sample_of("Such a Wretched, plain wretchedness! " + "x" * 50, {b"wretc"}) == b" wretched  wretchedness "
    assert toxicity.sample_of(None, {b"wretc"}) == b""
    a, b = toxicity.dictionaries([b" plain words here "] * 3, [])
    assert a == b
    a, b = toxicity.dictionaries([b" plain words here "] * 3, [b" wretched "])
    assert len(b) > len(a) and b.endswith(a)


def test_one_row_a_label(spark):
    """Documents that repeat a labelled id give one row to learn from."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other words here")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1), (1, 1), (2, 0)], "doc_id long, toxic int")
    s = toxicity.train(spark, docs, lab, F.lit(False))
    assert toxicity.score(docs, s).count() == 51


def test_toxicity_of_one_kind_is_constant(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, 0) for i in range(8)], "doc_id long, toxic int")
    s = toxicity.score(docs, toxicity.train(spark, docs, lab, F.lit(False))).toPandas()["score"]
    assert s.nunique() == 1 and s.iloc[0] == pytest.approx(0.1)


def test_katz(spark, data, edge):
    for d in (data, edge):
        docs = docs_of(spark, d)
        tokens = [[x.translate(common._TO_LOWER) for x in WORD.findall(t or "")] + ["\n"] for _, t, _ in docs]
        held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _, _ in docs]
        c = collections.Counter(x for w, h in zip(tokens, held, strict=True) if not h for x in w)
        n, v = sum(c.values()), len(c)
        want = sorted((h, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for w, h in zip(tokens, held, strict=True))
        got = OPS["op3_katz"](spark, d).toPandas()
        assert sorted((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got.itertuples()) == want
        assert np.isfinite(got["score"]).all() and (got["score"] <= 0).all()
        if d == data:
            assert got.loc[got["held_out"], "score"].sum() > got.loc[got["held_out"], "base_score"].sum()


def katz_by_hand(texts, train):
    """The model's definition with dictionaries: log10 P(w | v) as a function, and the tokens of each text."""
    tokens = [[x.translate(common._TO_LOWER) for x in WORD.findall(t or "")] + ["\n"] for t in texts]
    c, pairs, ctx = collections.Counter(), collections.Counter(), collections.Counter()
    for w, t in zip(tokens, train, strict=True):
        if t:
            c.update(w)
            pairs.update(zip([None, *w], w, strict=False))
            ctx.update([None, *w[:-1]])
    d1, d2 = (katz.discounts(collections.Counter(x.values())) for x in (c, pairs))
    cut = lambda n, d: n * (d[n] if n <= katz.MOST else 1.0)
    n = sum(c.values())
    off = sum(k - cut(k, d1) for k in c.values())
    total = n if off else n + 0.5
    low = lambda w: cut(c[w], d1) / total if c[w] else (off or 0.5) / total
    seen, below = collections.Counter(), collections.Counter()
    for (v, w), k in pairs.items():
        seen[v] += cut(k, d2)
        below[v] += low(w)

    def p(v, w):
        if pairs[v, w]:
            return cut(pairs[v, w], d2) / (ctx[v] + 0.5)
        return low(w) * ((1 - seen[v] / (ctx[v] + 0.5)) / (1 - below[v]) if ctx[v] else 1.0)

    return p, tokens, c


@pytest.mark.parametrize("sizes", [{}, {"bucket": 2000, "heavy": 20}])
def test_katz_scores(spark, data, edge, sizes, monkeypatch):
    """Every score is the definition's, whatever the buckets and the heavy contexts."""
    for d in (data, edge):
        docs = common.read(spark, d, "documents")
        rows = docs.select("doc_id", "text").collect()
        train = [zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 != 1 for r in rows]
        p, tokens, _ = katz_by_hand([r["text"] for r in rows], train)
        want = sorted((-1 if r["doc_id"] is None else r["doc_id"], sum(math.log10(p(v, x)) for v, x in zip([None, *w], w, strict=False))) for r, w in zip(rows, tokens, strict=True))
        got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in katz.Katz(spark, docs, common.crc_mod(F.col("doc_id"), 5) != 1, **sizes).scores().collect())
        assert [i for i, _ in got] == [i for i, _ in want]
        assert np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-9, atol=1e-6)


def test_katz_is_normalised(spark, edge):
    """After any word, all tokens of training and the unknown one sum to one; so does what a bucket of the stored table gives."""
    docs = common.read(spark, edge, "documents")
    p, _, c = katz_by_hand([r["text"] for r in docs.select("text").collect()], [True] * docs.count())
    for v in [None, "word1", "w5", "one", "a", "nowhere"]:
        assert sum(p(v, w) for w in [*c, "nowhere"]) == pytest.approx(1)
    m = katz.Katz(spark, docs, F.lit(True))
    stored = m.bigrams.where("part >= 0").select("data").collect()
    assert stored
    heavy = katz.heavy_codes(m.model.uni, katz.HEAVY)
    for r in stored[:20]:
        ctx, runs, w, n0, n = katz.unpack(bytes(r["data"]), np.int64, np.uint32, np.int64, np.int64, np.int64)
        log_p, alpha = m.model.log_p(ctx, runs, w, n0, n)
        low = m.model.uni.p(katz.counts_of(w, n0, m.model.uni))
        ends = np.cumsum(runs.astype(np.int64))
        for v, a, x, y in zip(np.cumsum(ctx), alpha, ends - runs, ends, strict=True):
            if v >= heavy and v != katz.START:
                assert (10 ** log_p[x:y]).sum() + a * (1 - low[x:y].sum()) == pytest.approx(1)


def test_packing_round_trip(spark, data, edge):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d in (data, edge):
        rows = packing.pieces(common.read(spark, d, "documents")).toPandas()
        assert ((rows["length"] & (rows["length"] - 1)) == 0).all() and rows["length"].max() <= 1024
        want = collections.Counter((str(i), tuple(slow.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t, _ in docs_of(spark, d))
        got = collections.Counter()
        key = rows["doc_id"].map(lambda x: str(None if pd.isna(x) else int(x)))
        for k, g in rows.groupby(key, sort=False):
            now: list = []
            for r in g.itertuples():  # a document's pieces follow each other
                if r.start == 0 and now:
                    got[(k, tuple(now))] += 1
                    now = []
                assert r.start == len(now)
                now += np.frombuffer(r.ids, "<u4").tolist()
            got[(k, tuple(now))] += 1
        assert got == want
    q = OPS["op4_packing"](spark, data).toPandas()
    assert q["sequence_id"].is_unique and (q["offset"] == 0).all() and (q.groupby("doc_id")["length"].sum() == q.groupby("doc_id")["doc_tokens"].first()).all()


def test_quality_counts(spark, data, edge):
    def brute(text):
        text = text or ""
        w = WORD.findall(text)
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)

    for d in (data, edge):
        got = OPS["op5_quality_rules"](spark, d).toPandas()
        cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
        assert sorted(map(tuple, got[cols].to_numpy().tolist())) == sorted(brute(t) for _, t, _ in docs_of(spark, d))
        assert not (got["kept"] & got["base_failed"]).any()


def test_quality_keeps_clean_and_rejects_odd(spark):
    rnd = random.Random(9)
    words = "the of and to in is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no".split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(200)), "en") for i in range(300)] + [(999, " ".join(chr(0x2600 + rnd.randrange(200)) for _ in range(52)), "en")]
    got = quality_rules.judge(spark, quality_rules.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).toPandas().set_index("doc_id")
    assert got.loc[:299, "kept"].mean() > 0.98 and not got.loc[999, "kept"] and not got.loc[999, "base_failed"]


def test_small_cells_have_bands(spark):
    rnd = random.Random(10)
    words = "the of and to in is that for it as was with be by on not he this are or his from at which but have an had they you".split()
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    odd = lambda n: " ".join("".join(rnd.choice("qxzjkvw") for _ in range(9)) for _ in range(n))
    rows = [(i, text(200), "en") for i in range(100)] + [(i, text(n), "en") for i, n in enumerate([400] * 5 + [5000] * 3, 100)]
    rows += [(200, odd(130), "en"), (201, odd(2000), "en"), (202, odd(60), "xx"), (203, text(200), "xx"), (204, text(200), None)]
    got = quality_rules.judge(spark, quality_rules.measure(spark.createDataFrame(rows, "doc_id long, text string, lang string"))).toPandas().set_index("doc_id")
    assert not got["base_failed"].any() and got.loc[:107, "kept"].mean() > 0.95
    assert got.loc[200:, "kept"].tolist() == [False, False, False, True, True]


def test_warc(spark, edge):
    got = OPS["op6_warc"](spark, edge).toPandas()
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in spark.read.parquet(f"{edge}/pages.parquet").collect()]
    first = {}
    for p, b in rows:
        first[b] = min((x for x in (p, first.get(b)) if x is not None), default=None)
    want = sorted((str(p), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if p == first[b] else "revisit", str(None if p == first[b] else first[b])) for p, b in rows)
    text = lambda x: str(None if pd.isna(x) else int(x))
    assert sorted((text(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, text(r.refers_to)) for r in got.itertuples()) == want


def test_warc_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    want = con.sql(queries.oracle_sql()["op6_warc"]).df().sort_values("page_id").reset_index(drop=True)
    got = OPS["op6_warc"](spark, data).toPandas().sort_values("page_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[list(want.columns)], want, check_dtype=False)


def test_warc_normaliser_round_trip():
    raws = [warc.record(i, f"http://x/{i}", bytes([i % 256]) * n, None, False) for i, n in enumerate((0, 1, 70_000, 3, 1_000_000))]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    whole = b"".join(map(z.compress, raws)) + z.flush()
    out = io.BytesIO()
    index = warc.normalise(io.BytesIO(whole), out)
    data = out.getvalue()
    assert [zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], 31) for x in index] == raws
    with pytest.raises(ValueError, match="inside a record"):
        warc.normalise(io.BytesIO(zlib.compress(raws[2][:100], wbits=31)), io.BytesIO())
    with pytest.raises(ValueError, match="gzip trailer"):  # cut at a record's border
        warc.normalise(io.BytesIO(zlib.compress(b"".join(raws[:2]), wbits=31)[:-8]), io.BytesIO())
    assert len(warc.normalise(io.BytesIO(b"".join(zlib.compress(r, wbits=31) for r in raws)), io.BytesIO())) == len(raws)


HTML = [
    ("<html><head><title>T</title></head><body><header>Site</header><nav><a>x</a></nav><article><h1>A &amp; B</h1><p>One<br>two <b>three</p><p>&lt;four&gt;\n five</p></article><footer>f", "A & B\nOne two three\n<four> five"),
    ("<body><div class='sidebar'>s</div><main><p>m<script>x='</p>'</script></p><form>q<input></form><aside>a</aside><p>n</main><div id=comments><p>c</div>", "m\nn"),
    ("<div><p>" + "word " * 60 + "</p><p>last</p></div>", ("word " * 60).strip() + "\nlast"),
    ("<article><p>a</p><div class='ad'>buy<div>now</div></div><p>b</p><section class='comments'><article>c</article></section></article>", "a\nb"),
    ("<div class=ad>left open<article><p>kept</p></article>", "kept"),
    ("<body><div class='page sidebar-left'><p>all there is</p></div>", "all there is"),
    ("<body><div class='layout has-sidebar'><p>text</p><div class='widget'>w</div></div>", "text"),
    # Names that only hint at something else: density decides.
    ("<article><p>" + "real text " * 30 + "</p><section id='discussion'><p>" + "more text " * 30 + "</p></section></article>", ("real text " * 30).strip() + "\n" + ("more text " * 30).strip()),
    ("<article><p>" + "real text " * 30 + "</p><div class='notice'><p>we use cookies</p></div><p>end</p></article>", ("real text " * 30).strip() + "\nend"),
    ("<article><p>" + "real text " * 30 + "</p><div class='related'>" + "<p><a href=x>some other article</a></p>" * 30 + "</div></article>", ("real text " * 30).strip()),
    # Neither a root nor names: surge and dive points decide.
    ("<div><a>Home</a><a>News</a></div><table></table><form></form><div><p>" + "real text " * 30 + "</p><p>short</p></div><form></form><div>all rights reserved</div>", ("real text " * 30).strip() + "\nshort"),
    # A root that holds next to nothing isn't one.
    ("<main><p>Loading</p></main><div><p>" + "real text " * 30 + "</p></div>", ("real text " * 30).strip()),
    ("", ""),
    (None, ""),
    ("plain &nbsp; text", "plain text"),
    ("<p>a < b and c</p>", "a < b and c"),
    ("<!-- never closed <p>x</p>", ""),
]


@pytest.mark.parametrize("html,want", HTML)
def test_html(html, want):
    assert html_text.main_text(html) == want


def test_html_density_decides(monkeypatch):
    """With the window sums switched off other texts come out."""
    want = [html_text.main_text(h) for h, _ in HTML]
    monkeypatch.setattr(html_text, "stretches", lambda lines: [(0, len(lines), 1)] if lines else [])
    assert sum(html_text.main_text(h) != w for (h, _), w in zip(HTML, want, strict=True)) >= 4


BROKEN = {
    "unclosed": "<div>" * 20_000 + "</span></p>" * 20_000, "no end": "<a " * 200_000, "one end": "<a " * 200_000 + ">", "quotes": "<a \">\"" * 50_000, "paragraphs": "<p><div>" * 20_000,
    "roots": "<nav>" * 20_000 + "<article>" * 20_000, "signs": "<" * 300_000, "attributes": "<p " + "a " * 200_000 + ">x", "tables": "<p><div>" + "<table><p>" * 30_000, "long": "<p>" + "word " * 400_000,
}


@pytest.mark.parametrize("name", BROKEN)
def test_html_takes_linear_time(name):
    import time

    began = time.perf_counter()
    html_text.main_text(BROKEN[name])
    assert time.perf_counter() - began < 20  # about a second; hours, if it grew with the square


def test_html_pages(spark, data):
    import html as h
    import re

    rows = {r["page_id"]: r["text"] for r in OPS["op7_html_extraction"](spark, data).collect()}
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        body = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1|div)[^>]*>", body)]
        assert rows[r["page_id"]] == "\n".join(b for b in blocks if b)


def brute_print(text):
    w = [x.translate(common._TO_LOWER) for x in WORD.findall(text or "")]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    ones = [0] * 64
    for g in grams:
        x = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            ones[b] += x >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams)) if grams else 0


def test_simhash(spark, data, edge):
    for d in (data, edge):
        docs = docs_of(spark, d)
        prints = [brute_print(t) for _, t, _ in docs]
        distinct = sorted(set(prints))
        sets = near_dups._Sets(len(distinct))
        for i, a in enumerate(distinct):
            for j in range(i):
                if (a ^ distinct[j]).bit_count() <= 3:
                    sets.join(i, j)
        least = {}
        for (i, _, _), p in zip(docs, prints, strict=True):
            r = sets.find(distinct.index(p))
            least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
        want = sorted((str(i), f"{p:016x}", str(None if i is None else least[sets.find(distinct.index(p))])) for (i, _, _), p in zip(docs, prints, strict=True))
        text = lambda x: str(None if pd.isna(x) else int(x))
        got = OPS["op8_simhash"](spark, d).toPandas()
        assert sorted((text(r.doc_id), r.fingerprint, text(r.component_id)) for r in got.itertuples()) == want


@pytest.mark.parametrize("large", [2000, 4])
def test_links_with_split_shards(spark, large):
    rnd = random.Random(1)
    codes = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(25):
            c = base
            for _ in range(rnd.randint(0, 5)):
                c ^= 1 << rnd.randrange(64)
            codes.add(c)
    codes = sorted(codes)
    sets = near_dups._Sets(len(codes))
    for i, a in enumerate(codes):
        for j in range(i):
            if (a ^ codes[j]).bit_count() <= 3:
                sets.join(i, j)
    nodes = spark.createDataFrame([(i, near_dups._signed(c)) for i, c in enumerate(codes)], "node long, code long")
    got = {r["node"]: r["component"] for r in near_dups.components(spark, near_dups.links(spark, nodes, 3, large)).collect()}
    assert [got.get(i, i) for i in range(len(codes))] == [sets.find(i) for i in range(len(codes))]


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 102), (101, 102)], "lo long, hi long")
    got = {r["node"]: r["component"] for r in near_dups.components(spark, chain).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100, 102: 100}


def test_near_copies_go_and_others_stay(spark):
    rnd = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bcdfgh" for b in ("an", "er", "ou") for c in ("st", "le", "ra", "ki")]
    rows, groups = [], {}
    for g in range(40):
        w = [rnd.choice(words) + (str(rnd.randrange(40)) if rnd.random() < 0.5 else "") for _ in range(250)]
        for k in range(4):
            x = list(w)
            for _ in range(0 if k == 1 else 3 * (k > 0)):
                x[rnd.randrange(len(x))] = rnd.choice(words)
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(x), "size"))
    rows += [(None, rows[0][1], "size"), (0, rows[0][1], "size")]
    out = near_dups.deduplicate(spark, spark.createDataFrame(rows, "doc_id long, text string, node string")).toPandas()
    left = collections.Counter(groups[int(i)] for i in out["doc_id"].dropna())
    assert set(left) == set(range(40)) and sum(left.values()) <= 42 and out["doc_id"].isna().sum() == 1
    assert list(out.columns) == ["doc_id", "text", "node"]


def passage_copies(n, seed=5):
    """Texts and copies with a passage appended, cut or replaced: (text, group)."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(20000)]
    some = lambda k: rnd.choices(vocabulary, cum_weights=weights, k=k)
    weights = list(np.cumsum(1 / np.arange(1, 20001)))
    out = []
    for g in range(n):
        w = some(rnd.choice([80, 200, 500, 2000]))
        k = len(w)
        at = rnd.randrange(k - k // 12)
        copy = [w + some(k // 10), w[: k - k // 10], w + some(k // 5), w[:at] + some(k // 12) + w[at + k // 12 :]][g % 4]
        out += [(" ".join(w), g), (" ".join(copy), g)]
    return out


@pytest.mark.parametrize("large", [2000, 3])
def test_copies_with_changed_passages_go(spark, large, monkeypatch):
    monkeypatch.setattr(near_dups.band_links, "__defaults__", (large,))
    texts = passage_copies(400)

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    like = {}
    for i in range(0, len(texts), 2):
        a, b = grams(texts[i][0]), grams(texts[i + 1][0])
        like[i // 2] = len(a & b) / len(a | b)
    left = collections.Counter(texts[r["doc_id"]][1] for r in near_dups.deduplicate(spark, spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")).collect())
    near = [g for g in like if like[g] >= 0.8]
    assert len(near) > 250 and sum(left[g] == 1 for g in near) >= 0.99 * len(near)
    assert all(left[g] == 2 for g in like if like[g] < 0.8)


def test_large_bands_are_split(spark):
    rnd = random.Random(6)
    w = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(200):
        x = list(w)
        x[rnd.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(x)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = near_dups.marked(docs).withColumnRenamed("doc_id", "node")
    pairs = near_dups.confirmed(spark, docs, near_dups.band_links(spark, nodes, 20))
    assert near_dups.components(spark, pairs).where("component = 0").count() == 199


def test_every_pair_of_a_large_band_meets(spark):
    rnd = random.Random(8)
    signs = [rnd.getrandbits(63) for _ in range(20)]
    rows = [(i, [7] * near_dups.BANDS, signs[i // 2], rnd.getrandbits(4)) for i in range(40)]
    got = near_dups.band_links(spark, spark.createDataFrame(rows, "node long, bands array<long>, s1 long, s2 long"), 2).distinct().collect()
    assert {(r["lo"], r["hi"]) for r in got} >= {(i, i + 1) for i in range(0, 40, 2)}


def test_failed_pairs_of_a_forest_leave_the_others_open(spark, monkeypatch):
    rnd = random.Random(9)
    while True:  # all share 0.78 to 0.795 of their shingles, the first two 0.805; the forest lacks the first two
        w, texts = [f"w{rnd.random()}" for _ in range(300)], []
        for i in range(18):
            at, k = 6 + 16 * i, 12 if i < 2 else 14
            texts.append(" ".join(w[:at] + [f"x{rnd.random()}" for _ in range(k)] + w[at + k :]))
        sign = np.array([near_dups.marks(t, near_dups._Hashes())[near_dups.PRINTS : near_dups.PRINTS + 2] for t in texts], np.uint64)
        if (0, 1) not in {tuple(sorted(p)) for p in near_dups.alike_pairs(sign[:, 0], sign[:, 1])}:
            break
    whole = near_dups.marked
    one = lambda docs: whole(docs).withColumns({"bands": F.array_repeat(F.lit(7).cast("long"), near_dups.BANDS)} | {f"c{i}": F.xxhash64("doc_id", F.lit(i)) for i in range(near_dups.PRINTS)})
    monkeypatch.setattr(near_dups, "marked", one)  # one group
    out = near_dups.deduplicate(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in out.collect()) == [0, *range(2, 18)]


def family(n, k, seed=10):
    """Near copies of one text of 140 words, each with up to k words changed, and their five-word shingles."""
    rnd = random.Random(seed)
    w, texts = [f"w{i}" for i in range(140)], []
    for i in range(n):
        x = list(w)
        for j in range(rnd.randint(1, k)):
            x[rnd.randrange(140)] = f"x{i}.{j}"
        texts.append(" ".join(x))
    grams = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in texts]
    sets = near_dups._Sets(n)
    for i in range(n):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if 5 * both >= 4 * (len(grams[i]) + len(grams[j]) - both):
                sets.join(i, j)
    return texts, [i for i in range(n) if sets.find(i) == i]


@pytest.mark.parametrize(("large", "piece"), [(2000, 1 << 20), (20, 4000)])
def test_a_family_of_near_copies_is_compared_without_its_pairs(spark, large, piece, monkeypatch):
    texts, want = family(300, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_dups.band_links, "__defaults__", (large,))
    monkeypatch.setattr(near_dups, "PIECE", piece, raising=False)
    proposed, written = [], near_dups.table

    def table(spark, df, name, *a):
        out = written(spark, df, name, *a)
        proposed.extend([out.count()] if name in ("proposed", "rest") else [])
        return out

    monkeypatch.setattr(near_dups, "table", table)
    out = near_dups.deduplicate(spark, docs)
    assert sorted(r["doc_id"] for r in out.collect()) == want and len(want) > 50
    assert sum(proposed) < 20_000  # of 44,850 pairs


def test_group_links_are_those_of_brute_force():
    for seed in range(60):
        rnd = np.random.default_rng(seed)
        n, base = int(rnd.integers(2, 40)), rnd.integers(0, 1000, int(rnd.integers(1, 60))).astype(np.uint64)
        rows = []
        for _ in range(n):
            x = base if rnd.random() < 0.5 else rnd.integers(0, 1000, int(rnd.integers(0, 40))).astype(np.uint64)
            x = np.concatenate([x[rnd.random(len(x)) > rnd.random() * 0.25], rnd.integers(1000, 1040, int(rnd.integers(0, 6))).astype(np.uint64)])
            rows.append(np.unique(x if rnd.random() > 0.05 else x[:0]))
        c, piece = rnd.integers(0, n, n), rnd.integers(0, 3, n) if seed % 2 else None
        got, want, first = near_dups._Sets(n), near_dups._Sets(n), {}
        for i, x in enumerate(c.tolist()):
            got.join(first.setdefault(x, i), i)
            want.join(first[x], i)
        assert all(got.join(i, j) for i, j in near_dups.group_links(rows, c, piece))
        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(rows[i], rows[j]))
                if (piece is None or piece[i] != piece[j]) and 5 * both >= 4 * (len(rows[i]) + len(rows[j]) - both):
                    want.join(i, j)
        assert [got.find(i) for i in range(n)] == [want.find(i) for i in range(n)]


def test_quality_classifier(spark, data):
    got = OPS["op9_quality_classifier"](spark, data).join(common.read(spark, data, "labels"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["quality"]).mean() >= 0.8


def test_factorisation_identity():
    rnd = np.random.default_rng(0)
    d = factorisation.BUCKETS + factorisation.STATISTICS
    m = factorisation.Machine(np.zeros(d), np.ones(d), 0.3, rnd.normal(size=d), rnd.normal(size=(d, 3)))
    x = rnd.normal(size=(2, d)) * 0.1
    slow = [0.3 + r @ m.linear + sum((m.factors[i] @ m.factors[j]) * r[i] * r[j] for i in range(d) for j in range(i)) for r in x]
    assert np.allclose(m.logit(x), slow)


def test_sketches(spark, data, edge):
    def shingles(t):
        w = WORD.findall(t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    docs = sorted(((i, t or "") for i, t, _ in docs_of(spark, data)), key=lambda x: x[0])
    got = OPS["op10_bottom_k"](spark, data).toPandas().set_index("doc_id")
    for k, (i, t) in enumerate(docs):
        after, q = docs[(k + 1) % len(docs)][1], len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        r = got.loc[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(t), shingles(edited), shingles(after)
        assert abs(r["near_edited"] - like(a, b)) < (0.2 if len(a | b) > sketches.SIZE else 1e-9)
        assert abs(r["near_next"] - like(a, c)) < 0.2
    edgy = OPS["op10_bottom_k"](spark, edge).toPandas()
    assert len(edgy) == len(awkward()) and edgy["near_edited"].between(0, 1).all()


def test_sketch_algebra(spark):
    parts = spark.createDataFrame([("a", "one two three four five six seven"), ("a", "three four five six seven eight"), ("b", "x"), ("c", "")], "k string, t string")
    df = parts.withColumn("s", sketches.sketch(F.col("t")))
    merged = {r["k"]: r["s"] for r in sketches.merge(df, ["k"], "s").collect()}
    own = {r["t"]: r["s"] for r in df.collect()}
    assert merged["a"] == sorted(set(own[awk[0]] + own[awk[1]])) if (awk := [t for t in own if "five" in t]) else False
    assert len(merged["b"]) == 1 and merged["c"] == []
    long = spark.createDataFrame([(LONG,)], "t string").select(sketches.sketch(F.col("t")).alias("s")).select(sketches.distinct_shingles(F.col("s")).alias("n")).first()["n"]
    true = len({tuple(LONG.split()[i : i + 5]) for i in range(60_000 - 4)})
    assert abs(long - true) < 0.35 * true
    c = df.where("k = 'a'").agg(F.max("s").alias("x"), F.min("s").alias("y")).select(sketches.containment(F.col("x"), F.col("y")).alias("c")).first()["c"]
    assert 0 < c <= 1


def test_sketches_of_hot_rows(spark, tmp_path, monkeypatch):
    """Rows that repeat more often than HEAVY_ROWS are dealt by salts and get the results of one row."""
    rows = [(i, f"text {i} of some words and more of them") for i in range(40)] + [(None, "")] * 300 + [(7, "a hot text of seven plain words")] * 200 + [(None, None)] * 50
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    calm = OPS["op10_bottom_k"](spark, str(tmp_path)).toPandas()
    monkeypatch.setattr(sketches, "HEAVY_ROWS", 9)
    split = OPS["op10_bottom_k"](spark, str(tmp_path)).toPandas()
    order = list(calm.columns)
    assert len(calm) == len(rows)
    pd.testing.assert_frame_equal(calm.sort_values(order, ignore_index=True), split.sort_values(order, ignore_index=True))
    assert split.drop_duplicates().shape[0] == 42


def test_sketches_use_no_python(spark, data):
    plan = OPS["op10_bottom_k"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_distinct_texts_of_an_id_stay(spark):
    rnd = random.Random(2)
    a, b, c = (" ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(80)) for _ in range(3))
    docs = spark.createDataFrame([(1, a), (1, b), (2, c), (1, a)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in near_dups.deduplicate(spark, docs).collect()) == sorted([(1, a), (1, b), (2, c)])


def test_pipeline_stages(spark, data):
    docs = common.read(spark, data, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = common.table(spark, stage(spark, docs, data), f"test-{name}")
        assert out.columns == columns and 0 < out.count() <= before
        assert out.join(docs, "doc_id", "left_anti").isEmpty()
        docs, before = out, out.count()
    mixed = common.table(spark, corpus_pipeline.mixture(spark, docs, data), "test-mixing")
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    packed = corpus_pipeline.packed(spark, mixed, data)
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in mixed.select("text").collect())
    assert packed.agg(F.sum("length")).first()[0] == want


def test_pipeline_drops_what_the_operator_rejects(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "train", lambda *_: toxicity_stub)
    toxicity_stub = type("Scorer", (), {"toxic": b"a", "ordinary": b"b"})
    monkeypatch.setattr(toxicity, "scored", lambda rows, scorer, name: rows.withColumn(name, F.col("text").cast("double")))
    monkeypatch.setattr(corpus_pipeline, "read", lambda *_: None)
    docs = spark.createDataFrame([(1, "0.29"), (2, "0.3"), (3, "0.45"), (4, "0.6")], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.toxic_filter(spark, docs, "").collect()] == [1]


def test_attach_stands_heavy_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"), "id").unionByName(spark.createDataFrame([(None, -1)], "k long, id long"))
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("k IS NOT NULL AND k % 2 = 1")
    got = common.attach(rows, facts, "k", 5000, "n", F.col("id")).toPandas()
    assert len(got) == 5001 and (got.loc[got["k"] == 7, "first"] == 0).all() and got.loc[got["k"].isna(), "first"].isna().all() and got["first"].notna().sum() == 3000 + 1000


def test_ranks(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(101)], "x long").repartition(7)
    got = common.ranked(spark, df, [F.col("x")], "rank", "test").collect()
    assert all(r["x"] == r["rank"] for r in got)
