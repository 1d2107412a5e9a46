"""The pipeline's stages: decisions take effect, clean documents stay, columns are those of documents."""

import random

import pytest
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    vocab = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = {i: "\n".join(say(12) + "." for _ in range(6)) for i in range(180)}
    for i in range(100, 180):
        texts[i] = " ".join(w + "###" for w in texts[i].split())
    item = say(20) + ". " + say(6) + "."
    texts[200] = texts[3] + " " + item
    texts[201] = texts[4]  # an exact copy
    w = texts[5].split(" ")
    w[10] = "changed"
    texts[202] = " ".join(w).replace("\n", " ")  # a near copy without its lines
    texts[203] = say(40) + "\n" + texts[6].split("\n")[2] + "\n" + say(30)  # a line that stands elsewhere
    texts[204] = ""
    docs = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(205, None, None, None, None)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{path}/benchmark.parquet")
    return f"file://{path}"


def test_stages(spark, folder):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES[:-1]:
        docs = P.write_table(stage(spark, docs, folder), "stage")
        assert docs.columns == COLUMNS
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [n for n, _ in P.STAGES]
    assert sum(i in kept[names[0]] for i in range(100)) >= 98 and sum(i in kept[names[0]] for i in range(100, 180)) <= 4
    assert 201 not in kept[names[1]] and len(kept[names[1]][203].split("\n")) == 2
    assert 202 not in kept[names[2]] and 5 in kept[names[2]]
    assert 200 not in kept[names[3]] and 3 in kept[names[3]]
    packed = P.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(kept[names[3]])
    assert P.run(spark, folder).count() == packed.count()


def test_stages_on_odd_rows(spark, folder, tmp_path):
    """Null and repeated ids, repeated rows, null and empty texts, other columns with names that operators use; and no rows."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    some = docs.filter("doc_id < 60 or doc_id in (200, 204, 205) or doc_id is null").withColumn("doc_id", F.when(F.col("doc_id") % 10 == 3, F.lit(None)).otherwise(F.col("doc_id")))
    some = some.unionByName(some.filter("doc_id = 8")).unionByName(some.filter("doc_id = 9").withColumn("text", F.concat(F.lit("another text under this id. "), F.reverse("text"))))
    for name in ("row", "set", "key", "n", "score", "predicted", "n_lines", "root", "_id", "c0"):
        some = some.withColumn(name, F.lit("clash"))
    some.write.parquet(f"file://{tmp_path}/documents.parquet")
    some = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    columns = some.columns
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    for name, stage in P.STAGES[:-1]:
        before = some.count()
        some = P.write_table(stage(spark, some, folder), "odd")
        assert some.columns == columns and 0 < some.count() <= before
        assert some.filter("score <> 'clash' or n_lines <> 'clash' or set <> 'clash'").isEmpty()
        assert stage(spark, some.limit(0), folder).count() == 0
    rows = some.select("doc_id", "text").collect()
    assert not [r for r in rows if r["text"] and item in r["text"]]  # the item's text stood under a null id too
    assert len([r for r in rows if r["doc_id"] == 8]) == 1 and len([r for r in rows if r["doc_id"] == 9]) == 2
    packed = P.STAGES[-1][1](spark, some, folder)
    assert packed.agg(F.sum("length")).first()[0] == packed.filter("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert P.STAGES[-1][1](spark, some.limit(0), folder).count() == 0


def test_near_duplicates_against_all_pairs(spark, sf):
    """Of rows that all pairs link, one of each group stays: no link of the sf table is lost."""
    import corpus_pipeline as P
    from test_operators import brute_groups

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    groups = brute_groups(rows, 5, 80)
    want = {i for i, n, c in groups if n == 0 or i == c}
    assert {r["doc_id"] for r in P.near_duplicates(spark, docs, sf).collect()} == want and len(want) < len(rows)


def test_only_what_the_result_reads_is_left(spark, folder):
    import os

    import corpus_pipeline as P
    from filingscope.tables import shared_dir

    root = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    P.run(spark, folder)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(root)) - before}
    assert left == {"benchmark_decontamination", "pieces"}
