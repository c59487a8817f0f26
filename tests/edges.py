"""Copies of the test tables without rows, and with nulls, repeated rows and extra columns."""

import os

import pyarrow as pa
import pyarrow.parquet as pq

DATA = "/root/testdata/sf0.001"
#: Columns that are ids by definition: never null.
IDS = {"result_id", "merged_id", "dump_id", "response_id", "record_id", "page_id", "request_id", "doc_id", "item_id", "snapshot_id"}


def empty(target):
    for name in os.listdir(DATA):
        t = pq.read_table(f"{DATA}/{name}")
        pq.write_table(t.slice(0, 0), f"{target}/{name}")
    return str(target)


def odd(target):
    """A few rows, those again under other ids, a row of nulls, and columns named like the operators' own."""
    for name in os.listdir(DATA):
        t = pq.read_table(f"{DATA}/{name}").slice(0, 12)
        first = t.schema.names[0]
        again = t
        if pa.types.is_integer(t.schema.field(first).type):
            moved = pa.compute.add(t.column(first), pa.scalar(1_000_000, t.schema.field(first).type))
            again = t.set_column(0, t.schema.field(first), moved)
        nulls = pa.table({f.name: pa.array([2_000_000 if f.name == first and f.name in IDS else None], f.type) for f in t.schema}, schema=t.schema)
        out = pa.concat_tables([t, again, nulls])
        for extra in ("code", "token", "host", "value", "key", "place", "class", "fp", "text"):
            if extra not in out.schema.names:
                out = out.append_column(extra, pa.array(["x"] * len(out)))
        pq.write_table(out, f"{target}/{name}")
    return str(target)
