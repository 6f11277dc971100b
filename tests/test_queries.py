"""Every query outside the training-data operators: equal to its SQL, or with the properties it must have."""

import pytest

from sparkloom.plans import content, eventlog, evidence, lineage, quality, relational, reports, rounds, streams
from tests.oracle import SF_DIR, compare

QUERIES = {**relational.QUERIES, **evidence.QUERIES, **quality.QUERIES, **reports.QUERIES, **streams.QUERIES, **rounds.QUERIES, **content.QUERIES, **eventlog.QUERIES, **lineage.QUERIES}
SQL = {**relational.SQL, **evidence.SQL, **quality.SQL, **reports.SQL, **streams.SQL, **rounds.SQL, **content.SQL, **eventlog.SQL, **lineage.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    compare(QUERIES[name](spark, SF_DIR), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_entry_points(spark):
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(QUERIES) <= set(queries) and set(sql) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0


def test_the_rest_never_imports_the_training_data_operators():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[1] / "sparkloom"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "sparkloom.llm" not in f.read_text(), f


def test_chunks_cover_the_text_in_order(spark):
    from sparkloom.operators.spans import chunks

    texts = [(1, "a b.\n\n" * 900), (2, "word " * 3000), (3, "x" * 5000), (4, "one\n\n\n\ntwo"), (5, "")]
    rows = chunks(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    for i, text in texts:
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.chunk_no)
        assert [r.chunk_no for r in own] == list(range(len(own)))
        assert all(len(r.text) <= 1200 and r.token_count == max(1, -(-len(r.text) // 4)) for r in own)
        assert "".join("".join(r.text.split()) for r in own) == "".join(text.split())


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://Example.COM:80/a/../b/?utm_source=x&b=2&a=1#frag", ("http://example.com/b?a=1&b=2", "example.com")),
        ("https://example.com", ("https://example.com/", "example.com")),
        ("https://bücher.de/x", ("https://xn--bcher-kva.de/x", "xn--bcher-kva.de")),
        ("https://www.google.com/url?q=https%3A%2F%2Fa.org%2Fp%3Fgclid%3D1", ("https://a.org/p", "a.org")),
        ("https://a.org/x%2Fy/?ref=1&ga_source=2&B=&utm_id=4", ("https://a.org/x%2Fy?B=&ref=1", "a.org")),
        ("https://duckduckgo.com/l?x=1&target=http%3A%2F%2Fb.org%2F", ("http://b.org/", "b.org")),
        ("https://www.bing.com/url?u=ftp%3A%2F%2Fb.org", ("https://www.bing.com/url?u=ftp%3A%2F%2Fb.org", "www.bing.com")),
        ("https://google.com/search?q=http%3A%2F%2Fb.org", ("https://google.com/search?q=http%3A%2F%2Fb.org", "google.com")),
        ("http://a.org:8080//x/./y/../z", ("http://a.org:8080//x/z", "a.org")),
        ("https://a.org/...", ("https://a.org/...", "a.org")), ("https://a.org/x/...//b/", ("https://a.org/x/.../b", "a.org")), ("http://a.org///x/", ("http://a.org/x", "a.org")),
        ("http://a.org//", ("http://a.org", "a.org")), ("http://a.org/.", ("http://a.org/", "a.org")), ("http://a.org/../..?b", ("http://a.org/?b=", "a.org")),
        ("ftp://example.com/x", None), ("not a url", None), (None, None), ("https://", None),
    ],
)
def test_canonical_urls(url, want):
    from sparkloom.functions.web import canonical

    assert canonical(url) == want


def test_statuses(spark):
    from pyspark.sql import functions as F

    from sparkloom.functions.verify import status

    cases = {(0, 0, 0): "unsupported", (2, 0, 0): "supported", (0, 1, 0): "unsupported", (0, 0, 1): "contradicted", (1, 0, 1): "mixed", (0, 3, 1): "mixed", (1, 4, 0): "supported"}
    df = spark.createDataFrame(list(cases), "s int, w int, c int")
    got = {(r.s, r.w, r.c): r.status for r in df.select("*", status(F.col("s"), F.col("w"), F.col("c")).alias("status")).collect()}
    assert got == cases


def test_statements_of_any_length_and_script_find_their_excerpts(spark):
    from sparkloom.operators.verification import verify

    said = {
        1: "Short fact is true.", 2: "北京是中华人民共和国的首都和政治中心。", 3: "Ok.", 4: "The turbine of the northern plant delivers nine megawatts every winter.",
        5: "The turbine of the northern plant never delivers nine megawatts every winter.", 6: "Harbour cranes lift containers weekly",
    }
    docs = {
        10: "Something else first. Short fact is true. And more.", 11: "前言。北京是中华人民共和国的首都和政治中心。后记。", 12: "It was fine\nOk.", 13: "Engineers say the turbine of the northern plant delivers nine megawatts every winter.",
        14: "Yes, harbour cranes lift\ncontainers  weekly in May.", 15: "", 16: None,
    }
    rows = verify(spark.createDataFrame(list(said.items()), "item_id long, text string"), spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    got = {(r.item_id, r.span_no, r.doc_id): (r.relation, r.score, r.pair) for r in rows}
    assert got[1, 0, 10] == got[2, 0, 11] == got[3, 0, 12] == ("support", 0.95, False)
    assert got[4, 0, 13] == ("support", 0.95, False)
    assert got[5, 0, 13][0] == "contradict"
    assert got[6, 0, 14] == ("support", 0.95, True)  # in two lines, so only the pair says it
    assert not any(d in (15, 16) for _, _, d in got)


def test_statements_without_tokens_overlap_whole_and_nothing_is_shuffled(spark):
    from sparkloom.operators.verification import verify

    said = spark.createDataFrame([(1, "Überall ñ. éé üü. Cranes lift nine heavy containers weekly."), (2, "不。")], "item_id long, text string")
    docs = spark.createDataFrame([(7, "ñ"), (8, "Say éé üü. Then cranes lift heavy containers weekly."), (9, "是不。")], "doc_id long, text string")
    found = verify(said, docs.repartition(8))
    whole = {(r.item_id, r.span_no, r.doc_id): (r.relation, r.overlap, r.meaningful_overlap) for r in found.collect()}
    assert whole[1, 1, 8] == whole[2, 0, 9] == ("support", 1.0, 0.0)
    assert whole[1, 2, 8][0] == "support" and abs(whole[1, 2, 8][1] - 5 / 6) < 1e-9
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not any(node in plan for node in ("Join", "Aggregate", "Window", "Sort"))
    both = verify(said, docs, block_bytes=40)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, found.collect()))


def test_a_manifest_changes_with_any_id(spark):
    from sparkloom.operators.reporting import manifest

    rows = [(i, "ab"[i % 2]) for i in range(4000)]
    of = lambda x: {r.status: (r.claims, r.content_hash) for r in manifest(spark.createDataFrame(x, "id long, status string"), "status", "id").collect()}
    whole, other = of(rows), of([*rows[:-2], (9999, "a"), rows[-1]])
    assert whole["a"][0] == 2000 and whole["b"] == other["b"] and whole["a"][1] != other["a"][1]
    assert of(rows[::-1]) == whole
    blocks = manifest(spark.createDataFrame(rows, "id long, status string"), "status", "id").collect()
    assert sorted(i for r in blocks if r.status == "a" for i in map(int, r.ids.split(","))) == list(range(0, 4000, 2))


def test_chunks_of_each_kind_get_their_reasons(spark):
    from pyspark.sql import functions as F

    from sparkloom.functions.quality import chunk_quality, diagram_or_config

    prose = "The reading room provides newspapers from forty countries, and visitors may borrow them for a week. It works on trust."
    cases = {
        "redirect_stub": "You are being redirected to the new page, click here if you are not redirected",
        "reference_section": "References Smith, Bachelor thesis (PDF) retrieved from doi:10.1/2",
        "navigation_noise": "Main menu Jump to content Privacy policy Cookie policy",
        "pointer_or_project_meta_noise": "Track development, send contributions and report issues",
        "diagram_or_config_section": "digraph g { a -> b } and more of the same here to be long",
        "leading_boilerplate_like": "Share Print Comments Email address Sign in Subscribe",
        "very_short": "Nothing",
        "short_meaningful_content": "It provides rooms and works for all of us.",
        "informative_prose": prose,
        "high_repetition": "wub dub " * 20,
    }
    df = spark.createDataFrame([(k, t) for k, t in cases.items()], "kind string, text string")
    got = {r.kind: r for r in chunk_quality(df, F.col("text"), F.lit("unrelated question"), F.lit(0.55), F.lit(0), F.lit(None).cast("string")).collect()}
    assert all(k in r.reasons.split(",") for k, r in got.items()), {k: r.reasons for k, r in got.items()}
    assert got["informative_prose"].eligible_for_claims and got["short_meaningful_content"].eligible_for_claims
    assert not any(got[k].eligible_for_claims for k in cases if k not in ("informative_prose", "short_meaningful_content"))
    text = "a -> b\nc -> d"
    flags = spark.createDataFrame([(text,), ("one: 1\ntwo: 2\nthree\nfour",), ("plain\ntext",)], "t string").select(diagram_or_config(F.col("t"))).collect()
    assert [r[0] for r in flags] == [True, True, False]


def test_evidence_density_squeezes_a_text_once_and_counts_each_signal(spark):
    import re

    from pyspark.sql import functions as F

    from sparkloom.functions import quality as Q

    texts = [
        None, "", " \n ", "According to the report of 2021-03-04, API v1.2.3 served 40% of 9 requests.", "paper  paper\npapers reported, released releases study", "benchmarks benchmarking benchmark_x sdk-api doi:arxiv",
        "A \"quote\" and “two”. " * 9, "experimental experiments; citation citations according  to 2019 20 ms",
    ]

    def plain(text):
        s = re.sub(r"\s+", " ", text or "").strip(" ")
        if not (text or "").strip(" "):
            return 0.45
        n = sum(len(re.findall(p, s.lower(), re.ASCII)) for p in Q.EVIDENCE_SIGNALS)
        quotes, stops = s.count('"') // 2 + s.count("“"), max(1, len(re.findall("[.!?。！？]", s)))
        return min(1.0, max(0.05, 0.18 + min(1.0, (n + min(quotes, 4)) / 12) * 0.62 + min(1.0, stops / 16) * 0.2))

    found = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", Q.evidence_density(F.col("text")).alias("density"))
    assert [r.density for r in found.orderBy("i").collect()] == pytest.approx(list(map(plain, texts)))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_spans_leave_a_task_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    from sparkloom.operators import spans

    class Docs:  # takes the function that tasks run
        def __getattr__(self, _):
            return lambda *a: self

        def mapInArrow(self, run, _):
            self.run = run
            return self

    docs = Docs()
    docs.select = lambda *a: docs
    spans.sentence_spans(docs, "doc_id")
    texts = ["One here. Two there.\n" * 500, None] * 100
    out = list(docs.run(iter([pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], names=["id", "text"])])))
    assert max(b.num_rows for b in out) <= 21_000 and sum(b.num_rows for b in out) == 100_000
    assert pa.Table.from_batches(out).column("excerpt").to_pylist() == ["One here.", "Two there."] * 50_000


def test_sentences_cut_in_tasks_are_those_of_the_column_functions(spark):
    """Odd texts: the same sentences and identities as by expressions; cut and squeezed in Python, so the plan has no regular expression of Spark's."""
    from pyspark.sql import functions as F

    from sparkloom.functions import text as T
    from sparkloom.operators import spans

    texts = [None, "", "   ", "...", "One. Two!  Three?", "\tTab one.\n \n x", "\u4f60\u597d\u3002\u518d\u89c1\uff01 ok", "\u0130stanbul \u212a \u00c9t\u00e9 \u03a3\u03a3. \U0001f642 a", "no end", " \u00a0 . b", "A\r\nB. " * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("span_no", "excerpt")).select("doc_id", F.col("span_no").cast("long"), "excerpt", T.claim_identity(F.col("excerpt")))
    want = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, spans.sentence_rows(docs, "doc_id").collect())) == [r[:3] for r in want]
    assert sorted(map(tuple, spans.sentence_identities(docs, "doc_id").collect())) == sorted((r[0], r[1], r[3]) for r in want)
    plan = spans.sentence_identities(docs, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "regexp" not in plan
