import random
import zlib

from pyspark.sql import functions as F

from tallyforge.llm import sharding
from tests.llm.conftest import ODD, SF


def test_curve_visits_neighbours(spark):
    side = 8
    cube = spark.range(side**3).select((F.col("id") % side).cast("int").alias("x"), (F.expr(f"id div {side}") % side).cast("int").alias("y"), F.expr(f"int(id div {side * side})").alias("z"))
    points = cube.withColumn("h", sharding.hilbert_index("x", "y", "z", bits=3)).orderBy("h").collect()
    assert [p.h for p in points] == list(range(side**3))
    steps = [abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) for a, b in zip(points, points[1:], strict=False)]
    assert set(steps) == {1}


def test_length_classes_rise_and_fit(spark):
    got = [r[0] for r in spark.range(8, 3_000_000, 101).select(sharding.length_class(F.col("id"))).collect()]
    assert got == sorted(got) and min(got) >= 0 and max(got) == 31


def held(rows, docs, shards=24):
    n = len(docs)
    size = lambda t: len((t or "").encode()) + 8
    assert sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in rows) == sorted(repr((d, size(t), zlib.crc32((t or "").encode()))) for d, t in docs)
    slots: dict = {s: [] for s in range(shards)}
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(v) for v in slots.values()]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    along = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert along == sorted(along)


def test_odd_rows(frame):
    held(sharding.hilbert_shards(frame(ODD)).collect(), ODD)
    docs = [(i % 17, "t" * (i % 5)) for i in range(100)]
    held(sharding.hilbert_shards(frame(docs)).collect(), docs)


def test_null_columns(spark):
    docs = spark.createDataFrame([(None, None, None, None)], "doc_id long, text string, source string, lang string")
    assert sharding.hilbert_shards(docs).first().asDict()["slot"] == 0


def test_empty_table(frame):
    assert sharding.hilbert_shards(frame([])).count() == 0


def test_whole_table(spark, documents):
    held(sharding.op8_hilbert_shards(spark, SF).collect(), [(r.doc_id, r.text) for r in documents.collect()])


def test_written_shards_hold_all(spark, documents, tmp_path):
    sharding.write_shards(documents, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("shard").distinct().count() == 24 and sorted(r.doc_id for r in back.collect()) == sorted(r.doc_id for r in documents.collect())


def test_name_classes_keep_the_order_of_names(spark):
    r = random.Random(2)
    names = ["", "host", *(f"host{r.randrange(50):02d}" for _ in range(300)), *["host07"] * 200, "hösté"]
    rows = spark.createDataFrame([(x, x[::-1]) for x in names], "y string, z string")
    got = rows.withColumns({f"{c}_class": k for c, k in sharding.name_classes(rows, ["y", "z"]).items()}).collect()
    for c in ("y", "z"):
        by = sorted((r[c].encode(), r[f"{c}_class"]) for r in got)
        assert [k for _, k in by] == sorted(k for _, k in by) and 8 <= len({k for _, k in by}) <= 32 and max(k for _, k in by) < 32


def test_filters_read_few_files(spark, tmp_path):
    """The share of files whose least and greatest value let a filter in, averaged over all values of a column."""
    sharding.write_shards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    for column, share in (("source", 0.45), ("lang", 0.6)):
        files = back.groupBy(F.input_file_name().alias("file")).agg(F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        values = [r[0] for r in back.select(column).distinct().collect()]
        read = [sum(f.lo <= v <= f.hi for f in files) / len(files) for v in values]
        assert len(files) >= 24 and sum(read) / len(read) <= share


def test_no_python_on_the_path(documents, plans):
    assert plans(sharding.hilbert_shards(documents), 2)


def test_rows_without_an_id_or_with_a_shared_one_are_written_once(spark, frame, tmp_path):
    docs = [*ODD, (None, "again"), (3, "a"), (3, "b"), (3, "b")]
    sharding.write_shards(frame(docs), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(repr((r.doc_id, r.text)) for r in back.collect()) == sorted(map(repr, docs)) and set(frame(docs).columns) <= set(back.columns)
