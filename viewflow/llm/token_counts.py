"""Tokens per document, counted in flat token files that have no index.

A file is ids one after another, each document closed by an end id. Blocks of a file are read independently and
searched for end ids with numpy; a prefix scan over the blocks' summaries tells each block how many documents ended
before it and how many ids of an open document it continues.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import filesystem, map_arrow, write_table
from .tokens import coder


def write_flat_files(docs: DataFrame, folder: str, tokenizer: str, end: int, *, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write one flat file for each partition; the files (file, ids, width), and whose documents they hold.

    The second table has (file, ordinal, doc_id): the files themselves don't know ids. A retried task writes a file
    of another name, and only files that a committed task reported are in the tables. Null texts are empty. Strings of
    special tokens are ordinary text here, since the end id must stand nowhere but at ends.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, name, n, total, out = coder(tokenizer, special_as_text=True), f"{uuid.uuid4().hex}.ids", 0, 0, None
        fs, root = filesystem(folder)
        for b in batches:
            out = out or fs.open_output_stream(posixpath.join(root, name))
            for _, _, ids, counts in code.encode_rows(b.column("text"), end):
                out.write(ids.tobytes())
                total += int(counts.sum())
            m = b.num_rows
            yield pa.RecordBatch.from_pydict({"file": [name] * m, "ordinal": np.arange(n, n + m), "doc_id": b.column("doc_id"), "ids": pa.nulls(m, pa.int64()), "width": pa.nulls(m, pa.int64())})
            n += m
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "ordinal": pa.nulls(1, pa.int64()), "doc_id": pa.nulls(1, pa.int64()), "ids": [total], "width": [code.width.itemsize]})

    made, _ = write_table(map_arrow(rows, write, "file string, ordinal long, doc_id long, ids long, width long", tokenizes=True), "flat")
    files = made.where("ids is not null").select(F.concat(F.lit(folder + "/"), "file").alias("file"), "ids", "width")
    return files, made.where("ids is null").select(F.concat(F.lit(folder + "/"), "file").alias("file"), "ordinal", "doc_id")


def token_counts(files: DataFrame, end: int, *, block_ids: int = 1 << 20) -> DataFrame:
    """(file, ordinal, n_tokens, closed) for every document in flat files (file, ids, width).

    n_tokens leaves out the end id. Ids after a file's last end id are one more document with ``closed`` false. An
    empty file has no documents; two end ids in a row close an empty document.
    """
    blocks = files.where("ids > 0").select("file", "ids", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(ids - 1) div {block_ids}"))).alias("block"))
    total = files.agg(F.sum("ids")).first()[0] or 0
    n = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(200_000, total // (8 * block_ids)))
    spread = blocks.repartition(n, "file", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                fs, path = filesystem(row["file"])
                start, width = row["block"] * block_ids, row["width"]
                n = min(block_ids, row["ids"] - start)
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(f.read_at(n * width, start * width), f"<u{width}")
                at = np.flatnonzero(ids == end)
                lengths = np.diff(at, prepend=-1) - 1
                yield pa.RecordBatch.from_pydict({
                    "file": [row["file"]], "block": [row["block"]], "start": [start], "stop": [start + n], "last": [row["ids"] == start + n],
                    "ended": [len(at)], "last_end": pa.array([start + int(at[-1]) if len(at) else None], pa.int64()), "lengths": pa.array([lengths.tolist()], pa.list_(pa.int64())),
                })

    found, _ = write_table(map_arrow(spread, search, "file string, block long, start long, stop long, last boolean, ended long, last_end long, lengths array<long>"), "ends")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = found.select("file", "block", F.coalesce(F.sum("ended").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("opened"))
    stitched = found.join(scan, ["file", "block"])
    carried = F.col("start") - F.col("opened") - 1
    closed = stitched.select("file", "base", carried.alias("carried"), F.posexplode("lengths").alias("k", "n"))
    closed = closed.select("file", (F.col("base") + F.col("k")).alias("ordinal"), (F.col("n") + F.when(F.col("k") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("closed"))
    rest = F.col("stop") - F.greatest(F.coalesce("last_end", F.lit(-1)), "opened") - 1
    left = stitched.where("last").select("file", (F.col("base") + F.col("ended")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(left.where("n_tokens > 0"))


def document_token_counts(docs: DataFrame, folder: str, tokenizer: str, end: int, **columns) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs``, by writing flat files and scanning them.

    Rows of equal or null id each get a row; null texts have no tokens; an empty table gives no rows.
    """
    files, names = write_flat_files(docs, folder, tokenizer, end, **columns)
    return names.join(token_counts(files, end), ["file", "ordinal"], "left").select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
