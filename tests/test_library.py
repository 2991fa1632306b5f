import datetime
import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from siltstone import catalogue
from siltstone.functions import filters, language, temporal
from siltstone.operators import documents as D
from siltstone.operators import chunking, evaluation, hygiene, ingest, rendering, retrieval, similarity, taxonomy
from siltstone.sources import formats, markdown, parsers

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(map(repr, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if name not in catalogue.SQL:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = con.execute(catalogue.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    assert mine == sorted(tuple(repr(r[names.index(c)]) for c in cols) for r in got.fetchall())


def test_filter_semantics(spark):
    df = spark.createDataFrame([(1, "x", 2.0, True, datetime.date(2024, 1, 2), ["a", "b"]), (2, None, None, None, None, None), (3, "y", float("nan"), False, datetime.date(2023, 1, 1), [])], "id int, s string, n double, b boolean, d date, t array<string>")
    ids = lambda text: [r.id for r in filters.apply(df, text).orderBy("id").collect()]
    assert ids("s = x") == [1] and ids("s != x") == [2, 3] and ids("NOT s = x") == [2, 3]
    assert ids("n > 1") == [1] and ids("n <= 5") == [1]
    assert ids("s NOT IN (x)") == [2, 3] and ids("s IN (x, y)") == [1, 3] and ids("s IN ()") == []
    assert ids('n = "2"') == [] and ids('n != "2"') == [1, 2, 3] and ids("none = 1") == [] and ids("none != 1") == [1, 2, 3]
    assert ids("t CONTAINS a") == [1] and ids("t ALL (a, b)") == [1] and ids("t ALL ()") == [1, 3] and ids("s CONTAINS x") == [1]
    assert ids("d >= 2024-01-01") == [1] and ids("b = true") == [1] and ids("b > false") == []
    assert ids("s=x,b=true") == [1] and ids("(s = x OR s = y) AND NOT (b = true)") == [3]
    assert ids(filters.Field("s").__eq__("x") & (filters.Field("n") >= 1)) == [1]
    for bad in ("", "!", "s =", 's = "x', "s = x extra", "(s = x"):
        with pytest.raises(filters.FilterError):
            filters.parse(bad)
    assert filters.from_json({"and": [{"eq": {"field": "s", "value": "x"}}, {"not_in": {"field": "n", "values": [1]}}]}) == filters.Bool("AND", (filters.Compare("s", "=", "x"), filters.Compare("n", "NOT IN", (1.0,))))
    assert filters.expand(filters.parse("cwe = CWE-79"), "cwe", {79: [79, 80]}) == filters.Compare("cwe", "IN", (79.0, 80.0))


def test_filter_contains_all_reads_whole_texts(spark, tmp_path):
    late = "x " * 30 + "the end of it"
    spark.createDataFrame([(1, late), (2, "of the"), (3, "x " * 30 + "the end"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in catalogue.QUERIES["filter_contains_all"](spark, str(tmp_path)).collect()) == [1, 2]


def test_chunk_overlap_keeps_characters_whole(spark):
    e = spark.createDataFrame([(1, 0, "paragraph", "aé"), (1, 1, "paragraph", "bbbb"), (1, 2, "paragraph", "c")], "doc_id long, pos long, kind string, text string")
    assert [r.text for r in chunking.chunk_basic(e, 4, 1).orderBy("chunk_index").collect()] == ["aé", "ébbbb", "bc"]


def test_temporal(spark):
    r = spark.range(1).select(temporal.policy(F.lit("the latest kernel exploit")).alias("a"), temporal.policy(F.lit("CVE-2026-1234 details")).alias("b"), temporal.factor(F.lit("2024-03-01").cast("date"), "2024-02-01", 60, 0.45).alias("c"), temporal.factor(F.lit(None).cast("date"), "2024-02-01", 60, 0.45).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("medium", "off", 1.0, 1.0)


def test_vectors(spark):
    r = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([2.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>").select(retrieval.cosine("a", "b").alias("c")).collect()
    assert [x.c for x in r] == [0.0, 0.0, 1.0]


def test_graph(spark):
    e = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (4, 3)], "child long, parent long")
    assert sorted(r.descendant for r in taxonomy.closure(e).where("ancestor = 1").collect()) == [1, 2, 3, 4]
    assert taxonomy.ancestors(e, e.select(F.col("child").alias("node")).distinct(), 0).count() == 0
    with pytest.raises(taxonomy.CycleError):
        taxonomy.closure(e.unionByName(spark.createDataFrame([(1, 4)], e.schema))).count()


def test_minhash_and_gold(spark):
    d = spark.createDataFrame([(1, "The quick brown fox, jumps!"), (2, "the quick  brown fox jumps"), (3, "abc")], "doc_id long, text string")
    s = {r.doc_id: r.sig for r in similarity.signatures(d).collect()}
    assert s[1] == s[2] and not any(s[3])
    hits = spark.createDataFrame([(1, 1, "alpha"), (1, 2, "Beta")], "query_id int, rank int, text string")
    g = evaluation.gold_score(hits, spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "x")], "query_id int, term string"), 5)
    assert sorted((r.query_id, r.satisfied_rank, r.missing) for r in g.collect()) == [(1, 2, 0), (2, None, 1)]


def test_parsers(spark):
    p = spark.createDataFrame([(1, "<html><title>T</title><body><nav><p>no</p></nav><main><h1>A</h1><p>b <b>c</b></p><table><tr><th>x</th></tr><tr><td>1</td></tr></table></main></body></html>"), (2, None)], "page_id long, html string")
    assert [(r.kind, r.text) for r in parsers.parse_html(p).orderBy("pos").collect()] == [("title", "A"), ("paragraph", "b c"), ("table", "| x |\n| --- |\n| 1 |")]
    r = spark.createDataFrame([('{"a": "2024-01-01", "b": 1, "c": [1], "d": null, "e": true, "f": "x"}',)], "j string")
    assert {x.field: x.kind for x in ingest.infer_fields(r, "j").collect()} == {"a": "date", "b": "numeric", "c": "array", "e": "bool", "f": "string"}


def test_formats(spark):
    rows = [("a/b.PDF", "x", "pdf"), ("a.b/c", "", "unknown"), (".md", "", "unknown"), ("x", "%PDF-1", "pdf"), ("x", " <?xml v", "xml"), ("x", "\n<!DOCTYPE html>", "html"), ("f.json", '{"format": "NVD_CVE"}', "nvd_feed"), ("f.txt", '"vulnerabilities" "format"', "nvd_feed"), (None, None, "unknown"), ("m.mkd", "<html>", "markdown")]
    got = spark.createDataFrame(rows, "path string, content string, want string").withColumn("got", formats.detect(F.col("path"), F.col("content"))).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_markdown(spark):
    text = "---\ntitle: x\n---\n# A\n\nb\nc\n## D ##\n- e\n1. f\n> g\n> h\n\n***\n```py\ni # j\n```\n| k |\n| - |\n| l |\n~~~\nopen"
    want = [("title", 0, "A", None), ("paragraph", 0, "b\nc", None), ("heading", 1, "D", None), ("list_item", 0, "e", None), ("list_item", 0, "f", None), ("quote", 0, "g\nh", None), ("horizontal_rule", 0, "", None), ("code", 0, "i # j", "py"), ("table", 0, "| k |\n| - |\n| l |", None), ("code", 0, "open", None)]
    d = spark.createDataFrame([(1, text), (2, None), (3, " \n"), (None, "x")], "doc_id long, text string")
    got = markdown.parse_markdown(d).orderBy("doc_id", "pos").collect()
    assert [(r.kind, r.depth, r.text, r.language) for r in got if r.doc_id] == want and [r.text for r in got if r.doc_id is None] == ["x"]


def test_entry_without_the_training_data_folders(tmp_path):
    """The entry lists the library's queries from a copy without the llm folder, with and without the pipeline file."""
    root = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(root / "siltstone", tmp_path / "siltstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if (root / "corpus_pipeline.py").exists():
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    for _ in range(2):
        got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
        assert got.stdout.split() == [str(len(catalogue.QUERIES)), "False", "True"]
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_recursive_chunks():
    r = chunking.recursive_pieces
    assert r("", 5) == [] and r("abc", 5) == ["abc"]
    assert r("aa\n\nbb\n\ncc", 6) == ["aa\n\n", "bb\n\ncc"]
    assert r("one two three four", 8) == ["one two ", "three ", "four"]
    assert r("a. bbbbbbbbbbbb c", 5) == ["a. ", "bbbbb", "bbbbb", "bb ", "c"]
    assert r("abcdefgh", 3, ()) == ["abc", "def", "gh"]
    assert r("ééé", 3, ("",)) == ["é�", "�é"] or r("ééé", 3, ("",)) == ["é�", "�é", ""]
    assert "".join(r("x y. z\n\n" * 400, 50)) == "x y. z\n\n" * 400 and max(map(len, r("x y. z\n\n" * 400, 50))) <= 50
    assert r("tiny\nbig big big\nend", 6) == ["tiny\n", "big ", "big ", "big\n", "end"]


def test_semantic_chunks():
    s = chunking.semantic_pieces
    assert s([], 10) == [] and s(["only one"], 10) == ["only one"] and s(["", " "], 10) == ["\n "]
    same = ["alpha beta gamma. alpha beta gamma. zzzz qqqq xxxx. zzzz qqqq xxxx"]
    assert s(same, 100) == ["alpha beta gamma. alpha beta gamma.", "zzzz qqqq xxxx. zzzz qqqq xxxx"]
    assert s(same, 20) == ["alpha beta gamma.", "alpha beta gamma.", "zzzz qqqq xxxx.", "zzzz qqqq xxxx"]
    assert s(same, 100, threshold=-1.0) == ["alpha beta gamma. alpha beta gamma. zzzz qqqq xxxx. zzzz qqqq xxxx"]
    assert len(s(same, 100, percentile=0)) == 1 and len(s(same, 100, percentile=100)) >= 2
    v = chunking.trigram_vectors(["ab", "abc", "ABC", ""])
    assert v[0][ord("a")] == 1 and v[0][ord("b")] == 2 and (v[1] == v[2]).all() and v[1].sum() == 1 and not v[3].any()


def test_boilerplate(spark):
    cases = [
        ("** REJECT ** This was issued in error.", " This was issued in error."),
        ("**DISPUTED** x", " x"),
        ("Affects cpe:2.3:a:apache:log4j:*:* and more", "Affects  and more"),
        ("See it.\nhttps://example.com/a\nFor details.", "See it.\n\nFor details."),
        ("See https://example.com/a for more.", "See https://example.com/a for more."),
        ("a\n\n  \n\t\nb\n\nc\n", "a\n\nb\n\nc"),
        ("\n\na", "a"),
        ("x NOTE: Link is provided\nNOTE: links are provided for you\ny", "x NOTE: Link is provided\ny"),
        ("** RESERVED ** All rights reserved.", "** RESERVED ** All rights reserved."),
        ("a\r\nb\r\n", "a\nb"),
        ("", ""),
    ]
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a string, b string").withColumn("got", hygiene.strip_boilerplate(F.col("a"))).orderBy("i").collect()
    assert [r.got for r in got] == [r.b for r in got]


def test_recency_detector(spark):
    yes = ["latest guidance on x", "newest kernel exploit", "recent CVE for nginx", "is it still exploited", "as of today what is open", "what came this week", "2026 vulnerabilities in chrome", "patch list of 2026", "current mitigation"]
    no = ["recent changes", "today we saw it", "CVE-2026-12345 details", "history of the vulnerability", "the latest", "last month's news", "current a b c d e f g exploit", "published in 2026"]
    got = spark.createDataFrame([(t,) for t in yes + no], "t string").select(temporal.policy(F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == ["medium"] * len(yes) + ["off"] * len(no)


def test_captions(spark):
    kinds = ["image", "paragraph", "image", "paragraph", "paragraph", "image"]
    texts = ["", "Figure 1 one", "", "fig. 2 two", "Table 3", ""]
    e = spark.createDataFrame([(1, i, k, 0, t) for i, (k, t) in enumerate(zip(kinds, texts))], "doc_id long, pos long, kind string, depth long, text string")
    got = {r.pos: (r.caption_id, r.image_id) for r in D.captions(e).collect()}
    assert got == {0: ("el-1", None), 1: (None, "el-0"), 2: ("el-3", None), 3: (None, "el-2"), 4: (None, "el-5"), 5: ("el-4", None)}
    for t, want in (("Figure 12: x", True), ("figure 3", True), ("Figures 1", False), ("Fig.1", False), ("  PLATE 9", True), ("table x", False)):
        assert spark.range(1).select(D.is_caption(F.lit(t))).first()[0] == want


def test_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars >= 200 AND lang IN ('en', 'de', 'fr', 'es')")
    r = d.select((language.detect(F.col("text"))["language"] == F.col("lang")).alias("ok")).agg(F.avg(F.col("ok").cast("int"))).first()[0]
    assert r > 0.9
    t = [("Это текст на русском языке", "ru"), ("これは日本語のテキストです", "ja"), ("这是中文文本", "zh"), ("한국어 텍스트", "ko"), ("", None), ("xyzzy", None)]
    got = spark.createDataFrame([(a,) for a, _ in t], "t string").select(language.detect(F.col("t"))["language"].alias("l")).collect()
    assert [x.l for x in got] == [b for _, b in t]
    f = spark.createDataFrame([("der Hund und die Katze sind in das Haus von den Leuten",), ("short",), ("the dog and the cat are in the house of the people",), (None,)], "t string")
    assert [x.f for x in f.select(language.filtered(F.col("t")).alias("f")).collect()] == ["", "short", "the dog and the cat are in the house of the people", None]
    assert f.select(language.filtered(F.col("t"), policy="flag").alias("f")).first().f.startswith("der")


def test_rendering_kinds(spark):
    rows = [("code", 0, "x <y", {"language": "py"}), ("list_item", 0, "a", {}), ("list_item", 0, "b", {}), ("image", 0, "i.png", {"alt": "pic"}), ("quote", 0, "q\nr", {}), ("horizontal_rule", 0, "", {}), ("form_field", 0, "v", {"field_name": "n", "field_type": "t"}), ("footnote", 0, "f", {"reference_id": "1"}), ("table", 0, "| a | b |\n| --- | --- |\n| 1 | <2 |", {}), ("heading", 7, "h", {})]
    e = spark.createDataFrame([(1, i, k, d, t, a) for i, (k, d, t, a) in enumerate(rows)], "doc_id long, pos long, kind string, depth long, text string, attrs map<string,string>")
    titles = spark.createDataFrame([(1, "T")], "doc_id long, title string")
    assert rendering.to_markdown(e, titles).first().markdown == "# T\n\n```py\nx <y\n```\n\n- a\n- b\n![pic](i.png)\n\n> q\n> r\n\n---\n\n**n** (t): v\n\n[^1]: f\n\n| a | b |\n| --- | --- |\n| 1 | <2 |\n\n######## h"
    html = rendering.to_html(e).first().html.split("\n")
    assert html[3] == '<pre><code class="py">x &lt;y</code></pre>' and '<img src="i.png" alt="pic">' in html and "<dl><dt>n (t)</dt><dd>v</dd></dl>" in html
    assert "<tr><th>a</th><th>b</th></tr>" in html and "<tr><td>1</td><td>&lt;2</td></tr>" in html and "<h6>h</h6>" in html and html[-2:] == ["</body>", "</html>"]
    c = spark.createDataFrame([(1, 0, "S", "x"), (1, 1, None, 'y "q"')], "doc_id long, chunk_index long, section string, text string")
    assert rendering.render_chunks(c, "markdown").first().rendered == '## S\n\nx\n\n---\n\ny "q"\n\n---'
    assert rendering.render_chunks(c, "html").first().rendered == '<h2>S</h2>\n<p>x</p>\n<hr>\n<p>y "q"</p>\n<hr>'
    assert rendering.render_chunks(c, "json").first().rendered.split("\n")[1] == '{"index":1,"char_count":5,"section":null,"text":"y \\"q\\""}'
    assert rendering.render_chunks(c, "text").first().rendered == 'x\n\ny "q"'
