"""Suffix-array dedup: a depth-limited radix sort finds every repeated byte string of a given length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats as R
from . import windows as W
from .common import few, keyed, tasks_for, written


def remove_repeated_bytes(docs: DataFrame, length: int = 200, gram: int = 24, together: int = R.TOGETHER) -> DataFrame:
    """Removes each byte that a `length`-byte string covers which also starts anywhere else.

    Suffixes are ordered only as deep as `length` bytes, most significant part first, and
    what is alone in its group after a pass is ordered far enough and leaves:

    1. by the anchor gram in their first `length` bytes (windows.py): the suffixes that
       share an anchor stand together as one run, so this pass moves about one record for
       every 80 bytes instead of one for each;
    2. by the run's content, as two independent 64-bit digests: equal runs consist of equal
       groups only, and are done;
    3. the runs that share an anchor only are read again and taken apart, and their suffixes
       ordered by their bytes, eight to a pass, until `length` bytes are done.

    Groups that remain at full depth are exactly the repeated strings. Pass 1 and 2 count
    with partial sums; a group of over `together` different runs in pass 3 is dealt into
    blocks, and what a block can't settle is counted by two digests of each window.

    Returns (row, n_bytes, spans: array of start and end in bytes, kept: binary) for every
    row. Null or empty text: no bytes. Texts shorter than `length` keep all. A repeated
    row, id included, counts as another place. Null ids are allowed. An empty table gives
    an empty result. `row` holds the input's columns, whatever their names.
    """
    unit = R.Unit(length, gram, False)
    tasks = tasks_for(docs)
    docs = keyed(docs)
    found = written(R.records(docs, unit), "suffixes", tasks)
    runs = found.groupBy("h", "c").agg(F.sum("times").alias("n"))
    anchors = runs.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1")
    open_runs = runs.join(anchors, "h", "left").filter("n > 1 OR m > 1")
    found = written(found.join(open_runs, ["h", "c"]), "open-suffixes", tasks)
    # of equal runs one is enough to compare with others
    wanted = found.filter("m > 1").groupBy("h", "c").agg(F.min(F.struct("_id", "_fp", "place")).alias("r"), F.max("m").alias("m")).select("h", "m", "r.*")
    wanted = written(R.fetched(docs, wanted, unit), "windows", tasks)
    spans = R.run_spans(found.filter("n > 1"), length).unionByName(R.resolved(wanted, unit, False, together, tasks).drop("place"))
    spans = written(spans, "spans", tasks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for x in batches for p in W.portions(x)):
            data, offsets = W.utf8(b.column("text"))
            gone = R.covered(b, offsets)
            edges = np.zeros(len(gone) + 1, bool)
            edges[1:-1] = gone[1:] != gone[:-1]
            edges[offsets[:-1]] = True
            first = np.flatnonzero(edges[:-1] & gone) if len(gone) else np.zeros(0, np.int64)
            edges[offsets] = True
            stops = np.flatnonzero(edges)
            last = stops[np.searchsorted(stops, first, side="right")]
            doc = np.searchsorted(offsets, first, side="right") - 1
            spans = pa.StructArray.from_arrays([pa.array(first - offsets[doc]), pa.array(last - offsets[doc])], names=["start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(b) + 1)).astype(np.int32)), spans)
            stay = ~gone
            at = np.concatenate(([0], np.cumsum(stay)))[offsets]
            kept = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[stay].tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.diff(offsets)), lists, kept], names=["row", "n_bytes", "spans", "kept"])

    joined = R.with_spans(docs, spans)
    return few(joined, tasks).mapInArrow(cut, R.result(joined, n_bytes="long", spans="array<struct<start:long,end:long>>", kept="binary"))
