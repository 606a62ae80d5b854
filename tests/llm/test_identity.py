"""Row numbers and what is joined by them do not depend on how a table's files are split."""
from pyspark.sql import functions as F

from quarry.llm.common import stored, with_uid
from quarry.llm.lines import dedup_lines
from quarry.llm.minhash import near_groups
from quarry.llm.mixing import interleave, slot_groups
from quarry.llm.packing import pack_groups
from quarry.llm.quality import passing


def _split(spark, cores):
    """Plan the next scans as if so many cores were registered."""
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(cores))
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    spark.conf.set("spark.sql.files.minPartitionNum", str(cores))


def _unset(spark):
    for k in ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
        spark.conf.unset(k)


def _table(spark, tmp_path, n=600):
    """Files of unequal size, so that another split deals them in another order."""
    words = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join(words[(i * 7 + j * (1 + i % 5)) % 90] for j in range(60 + i % 40)) + "\n" + f"shared line number {i % 50} that some have",
             "en", f"s{i % 3}", 10) for i in range(n)]
    path = str(tmp_path / "docs")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartitionByRange(13, F.pow(F.col("doc_id"), 2)).write.option("maxRecordsPerFile", 37).parquet(path)
    return spark.read.parquet(path)


def test_numbers_survive_another_split(spark, tmp_path):
    docs = _table(spark, tmp_path)
    try:
        _split(spark, 16)
        a = with_uid(docs.select("doc_id", "text"))
        first = {r.doc_id: r.uid for r in a.select("doc_id", "uid").collect()}
        _split(spark, 3)
        second = {r.doc_id: r.uid for r in with_uid(spark.read.parquet(docs.inputFiles()[0].rsplit("/", 1)[0])).select("doc_id", "uid").collect()}
    finally:
        _unset(spark)
    assert first == second and len(set(first.values())) == 600


def test_stages_survive_another_split(spark, tmp_path):
    """The second scan of each operator is planned for other cores than the first."""
    docs = _table(spark, tmp_path)
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    runs = {}
    try:
        for cores in (16, 3):
            _split(spark, cores)
            out = {"lines": dedup_lines(docs), "near": near_groups(docs).drop("uid"), "pass": passing(docs),
                   "mix": interleave(docs), "pack": pack_groups(docs, slot_groups(docs)).drop("sequence_id", "offset")}
            _split(spark, 19 - cores)  # frames are lazy: the final join scans with another split
            runs[cores] = {k: key(v) for k, v in out.items()}
    finally:
        _unset(spark)
    assert runs[16] == runs[3]
    assert len(runs[3]["pass"]) + 0 <= 600 and len(runs[3]["mix"]) == 600


def test_computed_frames_are_stored(spark, tmp_path):
    docs = _table(spark, tmp_path, 60)
    assert stored(docs) is docs and stored(docs.where("doc_id > 3").select("text"))
    made = docs.join(docs.select("doc_id"), "doc_id")
    kept = stored(made)
    assert kept is not made and kept.count() == 60
    assert with_uid(made).select("uid").distinct().count() == 60
    assert with_uid(docs.select(F.explode(F.split("text", " ")).alias("w"))).select("uid").distinct().count() > 60
