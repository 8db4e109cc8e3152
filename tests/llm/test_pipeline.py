"""The pipeline against the brute-force versions of its stages."""

import corpus_pipeline as cp
from test_dedup import plain_components
from test_line_dedup import brute
from test_quality import brute_rules, brute_sites
from test_tokens import plain_pieces

from gridloom.session import materialise

SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = rows_of(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "quality")
    columns = docs.columns
    stages = dict(cp.STAGES)
    assert [name for name, _ in cp.STAGES] == ["quality classifier", "quality rules", "line dedup", "SimHash near-dedup", "packing"]

    def after(name, before):
        out = materialise(stages[name](spark, before, SF), "stage")
        assert out.columns == columns
        return out

    good = after("quality classifier", docs)
    want = {r[0] for r in brute_sites(rows_of(docs, "doc_id", "text", "source", "lang"), labels) if r[-1]}
    assert {r[0] for r in rows_of(good, "doc_id")} == want and len(want) < docs.count()

    ruled = after("quality rules", good)
    want = {r[0] for r in brute_rules(rows_of(good, "doc_id", "text", "lang")) if r[-1]}
    assert {r[0] for r in rows_of(ruled, "doc_id")} == want

    deduped = after("line dedup", ruled)
    want = {(i, t, len(t)) for i, t, n, gone in brute(rows_of(ruled, "doc_id", "text"), 50) if gone == 0 or gone < n}
    assert set(rows_of(deduped, "doc_id", "text", "n_chars")) == want

    single = after("SimHash near-dedup", deduped)
    want = {i for i, _, c in plain_components(rows_of(deduped, "doc_id", "text")) if i == c}
    assert {r[0] for r in rows_of(single, "doc_id")} == want

    pieces = stages["packing"](spark, single, SF).collect()
    plain_pieces(pieces, rows_of(single, "doc_id", "text"), 4096)
    run = cp.run(spark, SF)
    assert {(p["doc_id"], p["doc_tokens"]) for p in run.collect()} == {(p["doc_id"], p["doc_tokens"]) for p in pieces}


def test_one_copy_of_each_group_stays(spark):
    body = "\n".join(f"this is line number {k} of a text that was copied often" for k in range(12))
    rows = [(k, body + f"\nlast words {k % 2}", "en", "s") for k in range(1, 9)] + [(20, None, "en", None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r[0] for r in cp.simhash_near_dedup(spark, docs, SF).collect()) == [1, 20]


def test_stages_on_odd_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(60).selectExpr("*", "'x' as words", "1 as kept", "cast(null as string) as fingerprint")
    odd = spark.createDataFrame(
        [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9002, "", "en", "s", 0), (None, "a b", None, "s", 3), (9003, "long " * 20_000, "en", "s", 100_000)],
        "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as words", "1 as kept", "cast(null as string) as fingerprint")
    rows = extra.unionByName(odd)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns and out.count() <= rows.count(), name
        assert stage(spark, rows.limit(0), SF).count() == 0, name
    packed = cp.pack(spark, rows, SF).collect()
    assert {p["doc_id"] for p in packed} == {r["doc_id"] for r in rows.select("doc_id").collect()}
    assert cp.pack(spark, rows.limit(0), SF).count() == 0
