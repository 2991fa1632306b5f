import collections
import hashlib
import math
import re
import tracemalloc
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import common, external_induction, op1_license_scan, op2_quality_classifier, op3_decontamination, op4_url_filters, op5_line_dedup, op6_lm_scoring, op7_suffix_dedup, op8_simhash, op9_quality_rules, op10_sentencepiece
from siltstone.llm.queries import QUERIES, oracle_sql

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, fp string, score int, n_words int, kept int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long and repeated texts, ties, clashing names."""
    long = "word " * 30_000 + "x" * 50_000
    line = "a rather long line that is here more than once in this table of texts"
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t", "en", "a"), (4, long, "en", None), (5, long, "xx", "a"), (5, long, "xx", "a"), (None, line, "en", "b"), (7, line + "\n" + line.replace("long", "lonk"), "en", "b"), (None, None, "de", "b")]
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "t", "f", 1, 2, 3) for i, t, g, s in rows], SCHEMA)


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = con.execute(oracle_sql()[name])
    names = [d[0] for d in got.description]
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert cols == sorted(names)
    assert sorted(tuple(map(repr, r)) for r in df.select(*cols).collect()) == sorted(tuple(repr(r[names.index(c)]) for c in cols) for r in got.fetchall())


def brute_spans(docs, size):
    count = collections.Counter(b[i : i + size] for _, b in docs for i in range(len(b) - size + 1))
    out = []
    for d, b in docs:
        cover = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                cover[i : i + size] = b"\1" * size
        kept = bytes(y for x, y in zip(cover, b) if not x)
        out.append((d, len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [20_000, 2])
def test_suffix_dedup(spark, monkeypatch, group):
    monkeypatch.setattr(op7_suffix_dedup, "GROUP", group)
    got = op7_suffix_dedup.op7_suffix_dedup(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(brute_spans([(d, (t or "").encode()) for d, t in texts(spark)], 200))


def test_induced_order_finds_repeats():
    rng = np.random.default_rng(1)
    rows = [bytes(rng.choice(list(b"ab"), n).tolist()) for n in (12, 14, 13, 12, 15)] * 2
    rows += [b"aaaaaaaaaaaaa"]
    lead = np.array([4, 5, 3, 4, 6] * 2 + [4])
    found = {(int(r), int(o)) for rs, os in op7_suffix_dedup.induce(np.ones(len(rows), np.int64), lead, rows, 8) for r, o in zip(rs, os)}
    place = collections.defaultdict(set)
    for i, (b, k) in enumerate(zip(rows, lead)):
        for o in range(min(len(b) - 7, k + 1)):  # windows that hold the aligned place
            place[(o - k, b[o : o + 8])].add((i, o))
    assert found == {x for v in place.values() if len(v) > 1 for x in v}


def test_segments_go_on_across_pieces(monkeypatch):
    rng = np.random.default_rng(7)
    docs = [bytes(rng.choice(list(b"abc"), n).tolist()) for n in (0, 199, 200, 640, 0, 901)] + [b"a" * 500]
    whole = op7_suffix_dedup.segment(docs)
    seen = {(int(d), int(b) + k) for d, b, c in zip(*whole[:3]) for k in range(int(c))}
    assert seen == {(d, k) for d, t in enumerate(docs) for k in range(len(t) - 199)}
    assert all(b <= p and p + 32 <= b + 200 and b + c - 1 <= p for _, b, c, p, _ in zip(*whole))  # the anchor lies in every window
    for piece in (7, 100, 333):
        monkeypatch.setattr(op7_suffix_dedup, "PIECE", piece)
        assert all(np.array_equal(x, y) for x, y in zip(whole, op7_suffix_dedup.segment(docs)))


def test_suffix_dedup_holds_little_at_once():
    """Megabytes of a task of 3 MB of text, and of one group of 20,000 segments; 174, 124 and 260 when all was held."""
    rng = np.random.default_rng(8)
    docs = [bytes(rng.integers(97, 123, 2_000, np.uint8)) for _ in range(1_500)]
    mark = pa.array([[{"idx": 0, "whole": False, "offs": [0, 1]}, {"idx": 2, "whole": True, "offs": []}]] * len(docs), pa.list_(pa.struct([("idx", pa.int32()), ("whole", pa.bool_()), ("offs", pa.list_(pa.int32()))])))
    marked = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), mark, pa.array(docs, pa.binary())], names=["doc_id", "marks", "bytes"])
    base, hot = rng.integers(97, 123, 368, np.uint8), []
    for _ in range(20_000):
        row = base.copy()
        row[rng.integers(0, 368)] = 65
        hot.append(row.tobytes())
    n = len(hot)
    group = pa.RecordBatch.from_arrays([pa.array([5] * n, pa.int64()), pa.array(range(n)), pa.array([168] * n, pa.int32()), pa.array(hot, pa.binary()), pa.array([1] * n, pa.int64())], names=["anchor", "sh", "lead", "bytes", "n"])
    for step, size in ((lambda: op7_suffix_dedup.segment(docs), 40), (lambda: list(op7_suffix_dedup._finish(iter([marked]))), 50), (lambda: [None for _ in op7_suffix_dedup._sorted_groups(iter([group]))], 80)):
        step()
        tracemalloc.start()
        step()
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert peak < size


def fingerprint_classes(docs):
    """{doc_id: (fingerprint, smallest id reachable)} of (doc_id, text) by all pairs."""

    def fingerprint(t):
        w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        h = [xxhash.xxh64_intdigest(x, 42) for x in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else []))]
        return sum((2 * sum(v >> b & 1 for v in h) > len(h)) << b for b in range(64)) if h else 0

    f = np.array([fingerprint(t) for _, t in docs], np.uint64)
    near, label = np.bitwise_count(f[:, None] ^ f[None, :]) <= 3, np.array([d for d, _ in docs])
    while True:
        new = np.where(near, label[None, :], 1 << 40).min(1)
        if (new == label).all():
            return {d: (f"{int(x):016x}", int(c)) for (d, _), x, c in zip(docs, f, label)}
        label = new


@pytest.mark.parametrize("bucket", [1024, 2])
def test_simhash(spark, monkeypatch, bucket):
    monkeypatch.setattr(op8_simhash, "BUCKET", bucket)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op8_simhash.op8_simhash(spark, SF).collect()}
    assert got == fingerprint_classes(sorted(texts(spark)))


def test_keep_one_decides_by_row(spark):
    """A copy of one of an id's texts takes only that row; null ids are held against each other and against rows with an id."""
    a, b, c, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abce")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, e), (None, c), (None, "u " + b[::-1]), (None, "u " + b[::-1])]
    kept = op8_simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (3, c), (3, e), (None, "u " + b[::-1])], key=repr)


def test_components_chain(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}}


def test_sentencepiece(spark):
    library = op10_sentencepiece.AgendaEncoder(op10_sentencepiece.model_file()).library
    want = []
    for d, t in texts(spark):
        ids = library.encode(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, op10_sentencepiece.op10_sentencepiece(spark, SF).collect())) == sorted(want)


def test_edit_distance(spark):
    def ed(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
            p = q
        return p[-1]

    rng = np.random.default_rng(3)
    rows = [("".join(rng.choice(list("abé"), rng.integers(0, 7))), "".join(rng.choice(list("abé"), rng.integers(0, 7)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, b string")
    for e in (1, 2):
        assert all(r.w == (ed(r.a, r.b) <= e) for r in df.select("a", "b", op5_line_dedup.within("a", "b", e).alias("w")).collect())


def test_language_model_prefers_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words, counts = op6_lm_scoring.vocabulary(docs)
    net = op6_lm_scoring.train(docs, words, counts)
    total = lambda n: sum(r.log_prob for r in op6_lm_scoring.score(docs, words, n).collect())
    assert total(net) > total(op6_lm_scoring.start(counts))
    flat = op6_lm_scoring.start(counts)
    rng, n = np.random.default_rng(0), op6_lm_scoring.unpack(flat)
    padded, place = np.concatenate([[0, 0], rng.integers(1, 1024, 9), [0, 0]]), np.arange(2, 11)
    before = op6_lm_scoring.step(n, padded, place, None).sum()
    for _ in range(20):
        op6_lm_scoring.step(n, padded, place, 0.1)
    assert op6_lm_scoring.step(n, padded, place, None).sum() > before


def test_language_model_words_of_a_bucket(spark, monkeypatch):
    """Buckets have their true counts, and the shares of a bucket's words and one unseen word have the sum 1."""
    monkeypatch.setattr(op6_lm_scoring, "RARE", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    count = collections.Counter(w for _, t in texts(spark) for w in re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower()))
    counted = op6_lm_scoring.word_counts(docs)
    words, counts, buckets = op6_lm_scoring._vocabulary(counted)
    assert counts.sum() == sum(count.values())
    h, logs, rare = op6_lm_scoring.shares(counted, words, buckets)
    assert len(h) == sum(n >= 2 for n in count.values()) - sum(count[w.encode()] >= 2 for w in words)
    own = dict(zip(h.tolist(), logs.tolist()))
    total = np.exp(rare.astype(float))
    for w in count.keys() - {w.encode() for w in words}:
        x = op6_lm_scoring.words_of(w)[2]
        k = int(op6_lm_scoring.bucket_of(x)[0])
        total[k] += np.exp(own.get(int(x[0]), rare[k]))
    assert len(h) and np.allclose(total, 1, atol=1e-4)
    flat = op6_lm_scoring.start(counts)
    with_share = {r.doc_id: r for r in op6_lm_scoring.score(docs, words, flat, share=(h, logs, rare)).collect()}
    assert all(r.log_prob >= with_share[r.doc_id].log_prob for r in op6_lm_scoring.score(docs, words, flat).collect())
    assert sum(r.n_tokens for r in with_share.values()) == sum(count.values())


def test_licences_without_an_anchor_word(spark):
    """Every paragraph is held against every template; none is lost to the gate."""
    lines = ["Permission is hereby granted, free of charge, to any person obtaining a copy", "this dataset is dedicated to the public domain", "a plain line", "in the public domain"]
    d = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    r = op1_license_scan.paragraphs(d).first()
    assert [(x.place, x.family) for x in r.licences if x.confirmed] == [(0, "mit"), (1, "public-domain")] and r.n_candidates == 0
    for ts in op1_license_scan._cover().values():
        for g in ts:
            without = [q for q in g if not set(q.split()) & set(op1_license_scan.gate())]
            assert 100 * len(without) < op1_license_scan.COVER * len(g)


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = op2_quality_classifier.classify(docs, labels, fit_rows=200).join(labels, "doc_id").select("kept", labels.quality.alias("y")).collect()
    assert np.mean([r.kept == (r.y == 1) for r in found]) > 0.95


def test_fit_rows_are_the_smallest_hashes(spark):
    df = spark.range(3000).selectExpr("id AS _id", "array(cast(id AS double)) AS x", "cast(id % 2 AS int) AS quality")
    rule = f"pmod(xxhash64(_id), {op2_quality_classifier.HASHES})"
    for most in (0, 1, 50, 2999, 5000):
        want = [r.x for r in df.orderBy(F.expr(rule), "_id").limit(most).collect()]
        assert [r.x for r in op2_quality_classifier._fit_rows(df, most)] == want


def _says(w, host, path):
    g = op4_url_filters.grams(host, path)
    return bool(g) and w[0] + sum(w[b + 1] for b in g) > 0


def test_url_model_on_unseen_words():
    """A fifth of the words is held out: with paths that tell, the model is right on their hosts; with neutral ones more often than not."""
    rows, words = op4_url_filters.labelled_urls(), [*op4_url_filters.BAD, *op4_url_filters.GOOD]
    telling, neutral = [], []
    for fold in range(5):
        held = {w for i, w in enumerate(words) if i % 5 == fold}
        w = op4_url_filters.fit([r for r in rows if not any(x in r[0] for x in held)])
        for i, (host, path, y) in enumerate(rows):
            if words[i // 4] in held:
                (telling if i % 4 % 2 else neutral).append(_says(w, host, path) == (y == 1))
    assert np.mean(telling) > 0.9 and np.mean(neutral) > 0.6


def test_url_scoring_uses_the_fitted_function(spark):
    rows = [(i, f"http://{h}{p}") for i, (h, p, _) in enumerate(op4_url_filters.labelled_urls())] + [(900, "a://b"), (901, "x://"), (902, "s://été.fr/12/😀"), (903, "s://" + "long" * 300 + ".com/")]
    w = op4_url_filters.weights()
    for r in op4_url_filters.judge(spark.createDataFrame(rows, "page_id long, url string")).collect():
        g = op4_url_filters.grams(r.host, r.path)
        assert r.score == (w[0] + sum(w[b + 1] for b in g) if g else 0) and (r.rule or (r.verdict == "block") == _says(w, r.host, r.path))


def test_odd_inputs(spark, odd):
    bench = spark.createDataFrame([(1, "a rather long line that is here more than once"), (2, None), (None, "word word")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for docs in (odd, odd.limit(0)):
        n = docs.count()
        assert op9_quality_rules.judge(docs).count() == n
        assert op3_decontamination.locate(docs, bench).count() == n
        assert op3_decontamination.locate(docs, bench.limit(0)).where("_match.n_hit > 0").count() == 0
        assert op5_line_dedup.remove_lines(docs).columns == docs.columns and op5_line_dedup.remove_lines(docs).count() == n
        assert op8_simhash.near_duplicates(docs).count() == n
        assert op7_suffix_dedup.repeated_spans(docs).count() == n
        assert op10_sentencepiece.encode_decode(docs, op10_sentencepiece.model_file()).count() == n
        assert op6_lm_scoring.pseudo_likelihood(docs).count() == n
        assert op1_license_scan.paragraphs(docs).count() == n
        assert op2_quality_classifier.classify(docs, labels).count() == n
        assert op9_quality_rules.filter_documents(docs).columns == docs.columns
    kept = op8_simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 0 and kept.where("doc_id = 4").count() == 1
    text = {r.doc_id: r.text for r in op5_line_dedup.remove_lines(odd).collect()}
    assert text[1] is None and text[7] == ""
    pages = spark.createDataFrame([(1, None, "x"), (2, "no scheme", "x"), (3, "HTTP://A.Example.NET/en/1?q", "x"), (4, "a://org/fr/", "x"), (5, "a://" + "z" * 10_000, "x")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op4_url_filters.judge(pages).collect()}
    assert got[1] == ("", "", None, "allow") and got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[4] == ("org", "/fr/", "org/fr/", "allow") and len(got[5][0]) == 10_000
    assert op4_url_filters.judge(pages.limit(0)).count() == 0


def test_quality_filter_is_the_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(0))
    got = op9_quality_rules.filter_documents(docs)
    assert got.columns == docs.columns and got.where("n_words = 'x' AND kept = 0").count() == got.count()
    want = op9_quality_rules.judge(docs).where("kept")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect())


def _line_dedup_by_hand(rows):
    """rows(doc_id, text) -> texts without repeated and near lines, by the definition."""
    has_word, order = re.compile(r"[^\x20\x09-\x0D]"), {}
    for d, t in sorted(set(rows), key=lambda r: r[0]):
        for pos, line in enumerate(t.split("\n")):
            if has_word.search(line):
                order.setdefault(line, (d, pos))

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < op5_line_dedup.NEAR_CHARS:
            return False
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]

    gone, seen = set(), collections.defaultdict(list)
    for x in sorted(order, key=order.get):
        if any(near(x, y) for n in (-1, 0, 1) for y in seen[len(x) + n]):
            gone.add(x)
        seen[len(x)].append(x)
    return {(d, t): "\n".join(x for i, x in enumerate(t.split("\n")) if not has_word.search(x) or (x not in gone and order[x] == (d, i))) for d, t in rows}


def test_pipeline_by_hand(spark, tmp_path):
    """The five stages against plain Python: SQL's verdicts, lines by definition, all pairs of fingerprints, window search, the library."""
    import corpus_pipeline

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    kept = {r[0] for r in con.execute(f"select doc_id from ({oracle_sql()['op9_quality_rules']}) where kept").fetchall()}
    rows = [(d, t) for d, t in texts(spark) if d in kept]
    assert 0 < len(rows) < len(texts(spark))
    cleaned = _line_dedup_by_hand(rows)
    rows = [(d, cleaned[d, t]) for d, t in rows]
    assert any(cleaned[r] != r[1] for r in cleaned)
    component = fingerprint_classes(rows)
    rows = [(d, t) for d, t in rows if component[d][1] == d]
    word = re.compile(rb"[0-9a-z\x80-\xff]+")
    low = lambda t: word.findall(t.encode().translate(op3_decontamination._LOW))
    items = [low(t or "") for (t,) in con.execute("select text from benchmark").fetchall()]
    windows = {tuple(w[i : i + min(10, len(w))]) for w in items if w for i in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(w) for w in windows}
    clean = [(d, t) for d, t in rows if not any(tuple(w[i : i + n]) in windows for w in [low(t)] for n in sizes for i in range(len(w) - n + 1))]
    assert len(clean) < len(rows)
    library = op10_sentencepiece.AgendaEncoder(op10_sentencepiece.model_file()).library
    want = []
    for d, t in clean:
        ids = library.encode(t)
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "tokenization"]


def test_pipeline_on_odd_tables(spark, odd, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "x y z"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    words = " ".join(f"the word{i} of and" for i in range(60))
    more = spark.createDataFrame([(20, words, "en", "a", 1, "t", "f", 1, 2, 3), (21, words, "en", None, 1, "t", "f", 1, 2, 3), (None, words, "en", "a", 1, "t", "f", 1, 2, 3)], odd.schema)
    for i, docs in enumerate((odd.unionByName(more), odd.limit(0))):
        docs.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/odd/benchmark.parquet").write.parquet(f"{tmp_path}/{i}/benchmark.parquet")
        here, names = docs, docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            here = stage(spark, here, f"{tmp_path}/{i}")
            assert here.columns == names, name
        ids = [r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/{i}").collect()]
        assert set(ids) <= {20, 21, None, 4, 5} and len(ids) == len(set(ids)), ids
        assert i == 0 or not ids


def test_posteriors_by_hand(spark, monkeypatch):
    """Empty labels: evidence 0.5 for all; else shrunken means and log-odds recomputed in plain Python from the evidence."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = op2_quality_classifier.classify(docs, labels).join(docs.select("doc_id", "source", "lang"), "doc_id").collect()
    e = np.array([r.evidence for r in got])
    mean = e.mean()
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        hosts[r.source].append(r.evidence)
        paths[r.source, r.lang].append(r.evidence)

    def strength(groups, about):
        inside = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values()) / len(e)
        between = np.mean([(np.mean(v) - about(k)) ** 2 for k, v in groups.items()])
        return min(1e4, max(1.0, inside / between)) if between > 0 else 1e4

    middle = np.mean([np.mean(v) for v in hosts.values()])
    kh, kp = strength(hosts, lambda k: middle), strength(paths, lambda k: np.mean(hosts[k[0]]))
    host = {k: (sum(v) + kh * mean) / (len(v) + kh) for k, v in hosts.items()}
    path = {k: (sum(v) + kp * host[k[0]]) / (len(v) + kp) for k, v in paths.items()}
    odds = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    assert len(hosts) > 2 and len(paths) > len(hosts)
    for r in got:
        q = 1 / (1 + math.exp(-(odds(r.evidence) + odds(path[r.source, r.lang]) - odds(mean))))
        assert abs(r.host_posterior - host[r.source]) < 1e-9 and abs(r.path_posterior - path[r.source, r.lang]) < 1e-9 and abs(r.quality - q) < 1e-9
        assert r.kept == (r.quality >= 0.5) or abs(r.quality - 0.5) < 1e-9
    none = op2_quality_classifier.classify(docs, labels.limit(0)).select("evidence", "quality").distinct().collect()
    assert [tuple(r) for r in none] == [(0.5, 0.5)]


def test_log_probabilities_by_hand(spark):
    """Every token's probability recomputed from the network's tables in plain numpy, one token at a time."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    counted = op6_lm_scoring.word_counts(docs)
    words, counts, buckets = op6_lm_scoring._vocabulary(counted)
    flat, share = op6_lm_scoring.train(docs, words, counts), op6_lm_scoring.shares(counted, words, buckets)
    net, own = op6_lm_scoring.unpack(flat), dict(zip(share[0].tolist(), share[1].tolist()))
    number = {w.encode(): i + 1 for i, w in enumerate(words)}
    side, span = op6_lm_scoring.SIDE, op6_lm_scoring.SPAN
    for r in docs.join(op6_lm_scoring.score(docs, words, flat, share=share), "doc_id").where("n_tokens < 400").collect():
        w = re.findall(rb"[0-9a-z\x80-\xff]+", r.text.encode().translate(op6_lm_scoring._LOW))
        h = [int(op6_lm_scoring.words_of(x)[2][0]) for x in w]
        bucket = op6_lm_scoring.bucket_of(np.array(h, np.uint64)) if h else []
        ids = [number.get(x, 1 + op6_lm_scoring.WORDS + int(b)) for x, b in zip(w, bucket)]
        total = 0.0
        for i, y in enumerate(ids):
            x = net["b"].astype(float).copy()
            for k, o in enumerate([o for o in range(-span, span + 1) if o]):
                x += net["e"][k][ids[i + o] if 0 <= i + o < len(ids) else 0]
            x = np.tanh(x)
            top, low = x @ net["c"] + net["cb"], x @ net["w"][y // side] + net["wb"][y // side]
            total += top[y // side] - np.log(np.exp(top).sum()) + low[y % side] - np.log(np.exp(low).sum())
            if w[i] not in number:
                total += own.get(h[i], share[2][bucket[i]])
        assert r.n_tokens == len(ids) and abs(r.log_prob - total) < 1e-3 * max(1, len(ids))


def test_template_lines_with_a_number(spark):
    """Lines that differ in a number only: hot keys are split to the digits, and the result is the definition's."""
    text = lambda i: "a template line that is here very often, its number is " + f"{i:05d}" + " and then it goes on " * 6
    numbers = [i * 7 for i in range(700)] + [12345, 2345]
    rows = [(i, text(x)) for i, x in enumerate(numbers)] + [(5000, text(7) + "x"), (5001, text(14)[1:])]
    got = {(r.doc_id): r.text for r in op5_line_dedup.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = _line_dedup_by_hand(rows)
    assert got == {d: want[d, t] for d, t in rows}


def test_benchmark_words_that_share_a_hash(spark):
    """Thue-Morse words collide in every polynomial hash modulo 2^64; they are told apart by their letters."""
    a = "a"
    while len(a) < 1024:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    assert op3_decontamination.words_of(a.encode())[2] == op3_decontamination.words_of(b.encode())[2]
    bench = spark.createDataFrame([(1, f"one {a} two"), (2, f"one {b} three")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x one {a} two"), (2, f"one {b} two"), (3, f"one {b} three"), (4, f"one {a} three")], "doc_id long, text string")
    got = {r.doc_id: (r._match.n_hit, list(r._match["items"])) for r in op3_decontamination.locate(docs, bench).collect()}
    assert got == {1: (3, ["1"]), 2: (0, []), 3: (3, ["2"]), 4: (0, [])}


def test_simhash_ids_of_other_types_and_clashing_names(spark):
    a = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([("x2", a, 1, 2, 3, 4), ("x10", a, 1, 2, 3, 4), ("y", "other text here", 1, 2, 3, 4), (None, a, 1, 2, 3, 4)], "doc_id string, text string, _gone int, _k int, _keep int, _i int")
    assert {(r.doc_id, r.component_id) for r in op8_simhash.near_duplicates(docs).collect()} == {("x2", "x10"), ("x10", "x10"), ("y", "y"), (None, "x10")}
    for d, ids in ((docs, ["x10", "y"]), (docs.where("doc_id IS NOT NULL"), ["x10", "y"])):
        kept = op8_simhash.keep_one(d)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == ids and kept.where("_gone = 1 AND _k = 2").count() == 2
    out = op5_line_dedup.remove_lines(docs)
    assert out.columns == docs.columns and out.where("_keep = 3 AND _i = 4").count() == 4


def test_shares_by_join_are_the_shares_sent(spark, monkeypatch):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = d.unionByName(d.where("doc_id < 5")).unionByName(d.where("doc_id = 7").select(F.lit(None).cast("long").alias("doc_id"), "text"))
    rows = lambda x: sorted(((r.doc_id, r.n_tokens, r.log_prob) for r in x.collect()), key=lambda t: (t[0] is None, t))
    sent = rows(op6_lm_scoring.pseudo_likelihood(docs))
    monkeypatch.setattr(op6_lm_scoring, "SENT", 0)
    joined = rows(op6_lm_scoring.pseudo_likelihood(docs))
    assert [x[:2] for x in sent] == [x[:2] for x in joined] and np.allclose([x[2] for x in sent], [x[2] for x in joined], rtol=1e-4, atol=1e-2)


def test_external_induction_by_hand():
    """Order and common prefixes against sorted suffixes, with queues that hold a few entries in memory, and with recursion."""
    rng = np.random.default_rng(0)
    for i in range(150):
        b = bytes(rng.integers(1, int(rng.integers(2, 5)), int(rng.integers(0, 60))).tolist()) * (1 + i % 2)
        places, prefixes = external_induction.suffixes(np.frombuffer(b, np.uint8), limit=int(rng.integers(1, 8)))
        order = sorted(range(len(b)), key=lambda k: b[k:])
        common_ = [0] + [next((m for m, (x, y) in enumerate(zip(b[p:], b[q:])) if x != y), min(len(b) - p, len(b) - q)) for p, q in zip(order, order[1:])]
        assert places.tolist() == order and prefixes.tolist() == common_[: len(b)]


def test_odd_inputs_give_their_values(spark, odd):
    """Nulls, empty, blank, long and repeated texts: what each operator says of them."""
    by = lambda x, *c: sorted(((r.doc_id, *(r[k] for k in c)) for r in x.collect()), key=lambda t: (t[0] is None, t[0] or 0, str(t[1:])))
    line = "a rather long line that is here more than once in this table of texts"
    assert [x[1:] for x in by(op1_license_scan.paragraphs(odd), "n_paragraphs", "n_candidates", "licences")] == [(0, 0, []), (0, 0, []), (0, 0, []), (1, 0, []), (1, 0, []), (1, 0, []), (2, 0, []), (0, 0, []), (1, 0, [])]
    licence = spark.createDataFrame([(1, "x " * 20_000 + "released under the mit license", "kept")], "doc_id long, text string, _p string")
    r = op1_license_scan.paragraphs(licence).first()
    assert r.n_paragraphs == 1 and [x.family for x in r.licences] == ["mit"]
    spans = by(op7_suffix_dedup.repeated_spans(odd), "n_bytes", "n_removed", "n_spans")
    assert [x for x in spans if x[0] in (1, 2)] == [(1, 0, 0, 0), (2, 0, 0, 0)] and {x for x in spans if x[0] in (4, 5)} == {(4, 200_000, 200_000, 1), (5, 200_000, 200_000, 1)}
    near = {(r.doc_id, r.component_id) for r in op8_simhash.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 1)} <= near
    tokens = by(op10_sentencepiece.encode_decode(odd), "n_tokens", "decoded_equal")
    assert tokens[0] == (1, 0, True) and tokens[1] == (2, 0, True) and all(x[2] for x in tokens) and tokens[3][1] == tokens[4][1] > 30_000
    scores = by(op6_lm_scoring.pseudo_likelihood(odd), "n_tokens", "log_prob", "mean_log_prob")
    assert scores[0] == (1, 0, 0.0, None) and scores[2] == (3, 0, 0.0, None) and scores[3][1] == 30_001 and scores[3][2] < 0 and scores[4][1:] == scores[5][1:]
    judged = by(op2_quality_classifier.classify(odd, spark.createDataFrame([], "doc_id long, quality int, toxic int")), "evidence", "kept")
    assert {x[1] for x in judged} == {0.5} and all(x[2] for x in judged) and len(judged) == 9
    bench = spark.createDataFrame([(1, line), (2, None), (None, "word word")], "item_id long, text string")
    hits = by(op3_decontamination.locate(odd, bench), "_match")
    assert [(d, m.n_words, m.n_hit, list(m["items"])) for d, m in hits if d in (1, 2, 4)] == [(1, 0, 0, []), (2, 0, 0, []), (4, 30_001, 30_000, [])] and next(m for d, m in hits if d == 7).n_hit == 27
    rules = by(op9_quality_rules.judge(odd), "n_words", "n_repeat_words", "base_failed", "kept")
    assert rules[0] == (1, 0, 0, True, False) and rules[3][:4] == (4, 30_001, 30_000, True)


@pytest.mark.parametrize("errors", [1, 2, 3])
def test_line_links_of_any_threshold(spark, monkeypatch, errors):
    """Lines that go for a near line before them, against all pairs by the plain edit distance."""
    rng = np.random.default_rng(errors)
    base = ["".join(rng.choice(list("abcd é"), 40)) for _ in range(12)]
    lines = list(base)
    for x in base * 6:
        y = list(x)
        for _ in range(rng.integers(0, errors + 2)):
            k, what = int(rng.integers(0, len(y))), int(rng.integers(0, 3))
            if what == 0:
                del y[k]
            elif what == 1:
                y.insert(k, "z")
            else:
                y[k] = "q"
        lines.append("".join(y))
    lines = list(dict.fromkeys(x + "." for x in lines))

    def ed(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            q = [i + 1]
            for j, y in enumerate(b):
                q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
            p = q
        return p[-1]

    want = {i for i, x in enumerate(lines) if any(min(len(x), len(y)) >= 32 and ed(x, y) <= errors for y in lines[:i])}
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id for r in op5_line_dedup.remove_lines(docs, errors).where("text = ''").collect()}
    assert len(want) > 20 and got == want


def _held_mb(pid):
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


def test_driver_gives_freed_memory_back(spark):
    jvm = spark.sparkContext._jvm
    memory, pid = jvm.org.apache.spark.unsafe.Platform, jvm.java.lang.ProcessHandle.current().pid()
    # blocks below the size that C's heap maps one by one; the last of each 50 stays, so that the freed ones lie between used ones
    at = [memory.allocateMemory(100_000) for _ in range(1000)]
    for i, x in enumerate(at):
        memory.setMemory(x, 1, 100_000)
    kept = at[49::50]
    for x in set(at) - set(kept):
        memory.freeMemory(x)
    before = _held_mb(pid)
    assert "Trim native heap" in common.give_back(spark)
    after = _held_mb(pid)
    for x in kept:
        memory.freeMemory(x)
    assert before - after > 50, (before, after)


def test_pipeline_stages_give_driver_memory_back(spark, monkeypatch):
    import corpus_pipeline

    calls = []
    monkeypatch.setattr(corpus_pipeline, "give_back", calls.append)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    for name, stage in corpus_pipeline.STAGES:
        calls.clear()
        stage(spark, docs, SF)
        assert calls == [spark, spark], name


def test_benchmark_words_take_few_powers(monkeypatch):
    monkeypatch.setattr(op3_decontamination, "_powers", [])
    block = op3_decontamination.Block([("a", b"one two three four"), (None, b"five")], 10)
    assert len(op3_decontamination._powers[0]) <= 64 and len(block.hashes) == 5
    few = op3_decontamination.words_of(b"one two three four")[2]
    many = op3_decontamination.words_of(b"one two three four " + b"x " * 5000)[2]
    assert len(op3_decontamination._powers[0]) > 10_000 and few.tolist() == many[:4].tolist()
