import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from tesserae.llm import token_files as tf

PATH = P.path("byte_bpe_50k.json")


def library():
    return Tokenizer.from_file(PATH)


def test_files_hold_every_document_in_order(spark, tmp_path):
    rows = [(i, f"text number {i} with  blanks\n and é漢 {'word ' * (i % 7)}", i) for i in range(50)]
    rows += [(50, None, 0), (51, "", 0), (51, "<|endoftext|> x", 0), (51, "", 0)]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string, start long")
    out = str(tmp_path / "tokens")
    tf.write_tokens(docs, PATH, out)
    got = sorted(tf.read_tokens(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    at = 0
    t = library()
    want = {}
    for i, text, _ in rows:
        want.setdefault(i, []).append([*t.encode(text or "", add_special_tokens=False).ids, 0])
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids)
        want[r.doc_id].remove(list(r.ids))
        at += r.n_tokens
    crc = {r.start: r.ids_crc32 for r in tf.with_crc32(tf.read_tokens(spark, out)).collect()}
    assert all(crc[r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)


def test_layout_has_page_indexes_and_encodings(spark, tmp_path):
    docs = spark.range(200).selectExpr("id as doc_id", "repeat('some words here ', 20) as text")
    out = tmp_path / "tokens"
    tf.write_tokens(docs, PATH, str(out))
    group = pq.ParquetFile(next(out.glob("part-*"))).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("ids.list.element", "start", "doc_id"))
    assert all(c.has_column_index for c in columns.values())


def test_empty_table(spark, tmp_path):
    out = str(tmp_path / "tokens")
    tf.write_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH, out)
    assert tf.with_crc32(tf.read_tokens(spark, out)).count() == 0


def test_cuts_of_odd_blanks_agree_with_whole_texts():
    import random

    import pyarrow as pa

    rng = random.Random(11)
    ts = [None, "", " ", "  ", " a", "a ", "a  b", "a  b", " ", "a\n b c", "a b\n", " a b\n ", "x", "　 y z", "don't, won't. it's|x a,b"] * 3
    ts += ["".join(rng.choices(["ab", " ", "c,", "\n", " ", "!", "  ", "é.", "x\ny", "a,\nb.", "|", "(z)", "<|endoftext|>", "<|endoftext|"], k=rng.randint(0, 30))) for _ in range(500)]
    whole = library()
    e = tf.LibraryEncoder(PATH)
    for part in (ts, ts[::-1]):
        got = []
        for rows, ids, counts in e.encoded(iter([pa.RecordBatch.from_arrays([pa.array(part, pa.string())], ["text"])])):
            at = np.cumsum(counts) - counts
            got += [ids[a : a + n].tolist() for a, n in zip(at, counts)]
        assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in part]
    assert list(e.encoded(iter([]))) == []


def test_added_tokens_get_the_librarys_ids():
    import pyarrow as pa

    end = "<|endoftext|>"
    ts = [f"a {end} b", end, end + end, f"{end} x", f"x {end}", f" {end}\n{end} ", "<|endoftext", f"q{end}q" * 50, "plain", None]
    e = tf.LibraryEncoder(PATH)
    got = []
    for _, ids, counts in e.encoded(iter([pa.RecordBatch.from_arrays([pa.array(ts, pa.string())], ["text"])])):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [library().encode(t or "", add_special_tokens=False).ids for t in ts]
    assert got[0] == [64, 220, 50256, 275]


def test_very_long_texts(spark, tmp_path):
    texts = ["x" * 300_000, "ab cd " * 60_000, "\n" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tf.write_tokens(docs, PATH, str(tmp_path / "t"))
    got = {r.doc_id: list(r.ids) for r in tf.read_tokens(spark, str(tmp_path / "t")).collect()}
    assert all(got[i] == [*library().encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts))


def scanned(df):
    """Rows that the Parquet reader gave and the columns it read, after running `df`."""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    node = run.executedPlan()
    while node.children().size():
        node = node.children().head()
    return node.metrics().apply("numOutputRows").value(), node.requiredSchema().fieldNames()


def test_selective_reads_skip_rows_and_columns(spark, tmp_path):
    out = str(tmp_path / "tokens")
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('document number ', id, repeat(' some words', 20)) as text")
    tf.write_tokens(docs, PATH, out, **{"parquet.block.size": str(1 << 17), "parquet.page.row.count.limit": "100"})
    groups = [pq.ParquetFile(f).metadata for f in (tmp_path / "tokens").glob("part-*")]
    assert sum(m.num_row_groups for m in groups) > 3
    some = tf.read_range(spark, out, 7000, 7100)
    rows, columns = scanned(some)
    assert 101 <= rows < 6000 and sorted(columns) == ["doc_id", "ids", "n_tokens"]
    assert sorted(r.doc_id for r in some.collect()) == list(range(7000, 7101))
    rows, columns = scanned(tf.read_metadata(spark, out))
    assert rows == 20_000 and "ids" not in list(columns)
