"""What a task makes of a batch is in memory piece by piece."""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.conftest import SF001


def test_pieces_are_bounded_and_whole():
    from quarry.session import PIECE_BYTES, pieces
    b = pa.RecordBatch.from_pydict({"id": list(range(5000)), "t": ["x" * 4000] * 5000})
    got = list(pieces(b, 1))
    assert len(got) > 1 and max(p.num_rows for p in got) * 4000 <= PIECE_BYTES
    assert [i for p in got for i in p.column(0).to_pylist()] == list(range(5000))
    assert [p.num_rows for p in pieces(b, 0, 2048)] == [2048, 2048, 904]


def test_embedding_does_not_depend_on_pieces():
    from quarry.operators import embed
    from pyspark.sql import types as T
    r = np.random.default_rng(2)
    words = [[f"w{x}" for x in r.integers(0, 50, n)] for n in r.integers(0, 30, 5000)]
    b = pa.RecordBatch.from_pydict({"id": list(range(5000)), "_t": words})
    run = embed._signed_sums(T.StructField("id", T.LongType()), 8, "v")
    parts = list(run([b]))
    assert len(parts) == 3
    one = {i: v for p in parts for i, v in zip(p.column(0).to_pylist(), p.column(2).to_pylist())}
    assert sorted(one) == [i for i, w in enumerate(words) if w]
    again = {i: v for x in (b.slice(0, 7), b.slice(7)) for p in run([x]) for i, v in zip(p.column(0).to_pylist(), p.column(2).to_pylist())}
    assert one == again


def test_postings_of_the_index_hold_positions(spark, tmpdir_fresh):
    """A block names its texts by small numbers, whatever the ids."""
    from quarry.operators.index import build_and_write_index, read_postings
    docs = spark.createDataFrame([("a", "red house"), ("b", "red red car"), ("c", None), ("d", "blue")], "source string, text string")
    path = f"{tmpdir_fresh}/index"
    build_and_write_index(docs, path)
    texts, blocks = read_postings(spark, path)
    assert blocks.schema["ids"].dataType.elementType.typeName() == "integer"
    held = (blocks.where("term = 'red'").select("segment", F.explode(F.arrays_zip("ids", "tfs")).alias("p"))
            .join(texts, "segment").where("pos = p.ids").select("chunk_id", "p.tfs"))
    assert sorted(r.tfs for r in held.collect()) == [1, 2]


def test_csv_rows_of_bounded_files(spark, monkeypatch):
    from quarry.plans import q_files
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    monkeypatch.setattr(q_files, "CSV_ROWS", 7)
    got = q_files.q_load_csv_files(spark, SF001)
    files = got.inputFiles()
    assert got.count() == docs.count() and len(files) >= docs.count() // 7


def test_csv_rows_stream_like_before():
    from quarry.sources.files import _csv_rows
    text = 'a,b\r\n1,"x\n\r y"\n2,é\n'
    assert [t for t, _ in _csv_rows(text.encode())] == ["a: 1\nb: x\n\r y", "a: 2\nb: é"]


def test_scan_lists_only_its_kind(spark, tmpdir_fresh):
    """Files of other suffixes are not in the scan; suffixes in either case are."""
    import os
    from quarry.sources.files import load_documents, scan_files
    for name in ("a.txt", "b.TXT", "c.Md", "d.csv", "e.pdf", "txt", "f.txt.bak"):
        with open(os.path.join(tmpdir_fresh, name), "w") as f:
            f.write("x,y\n1,2\n")
    names = lambda df, c="path": sorted(r[0].rsplit("/", 1)[1] for r in df.select(c).collect())
    scan = scan_files(spark, tmpdir_fresh, (".txt",))
    assert names(scan) == ["a.txt", "b.TXT"] and len(scan.inputFiles()) == 2
    docs, errors = load_documents(spark, tmpdir_fresh)
    assert names(docs, "source") == ["a.txt", "b.TXT", "c.Md", "d.csv"] and names(errors, "source") == ["e.pdf"]
    only, _ = load_documents(spark, tmpdir_fresh, suffixes=(".csv",))
    assert names(only, "source") == ["d.csv"]
