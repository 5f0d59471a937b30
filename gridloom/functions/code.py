"""Program text through its syntax tree, in Arrow batches."""

from __future__ import annotations

import ast
import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import parse_json, without_fence

FUNCTION = "ARRAY<STRUCT<name:STRING, docstring:STRING, code:STRING, stub:STRING, kind:STRING>>"


def functions(source: str) -> list[dict]:
    """Top-level functions and classes: name, docstring, code, and the signature with the docstring only."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            doc = ast.get_docstring(node)
            body = [ast.Expr(ast.Constant(doc))] if doc else []
            stub = type(node)(**{k: getattr(node, k) for k in node._fields} | {"body": [*body, ast.Pass()], "decorator_list": []})
            out.append({"name": node.name, "docstring": doc, "code": ast.get_source_segment(source, node), "stub": ast.unparse(ast.fix_missing_locations(stub)), "kind": "class" if isinstance(node, ast.ClassDef) else "function"})
    return out


def calls(source: str) -> list[str]:
    """Names of all functions called, in order of the alphabet."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    names = {n.func.id if isinstance(n.func, ast.Name) else n.func.attr for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))}
    return sorted(names)


def literal(text: str):
    """A Python literal's JSON-like value; None if it is none."""
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None


def json_of_literals() -> Callable[[Column], Column]:
    """A function of a text column: the JSON of a Python literal, null where it is none."""

    @F.pandas_udf("string")
    def turn(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for t in s:
                v = literal(t) if t else None
                try:
                    out.append(json.dumps(v) if isinstance(v, (dict, list)) else None)
                except (TypeError, ValueError):
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return turn


def parse_any_json(t: Column, schema: str) -> Column:
    """As text.parse_json, and what that cannot read as a Python literal."""
    read = parse_json(t, schema)
    return F.coalesce(read, F.from_json(json_of_literals()(F.when(read.isNull(), without_fence(t))), schema))


def with_syntax(df: DataFrame, source: str = "content") -> DataFrame:
    """df with `functions` and `calls` of the program in a column."""
    out = T.StructType([*df.schema.fields, T.StructField("functions", T.DataType.fromDDL(FUNCTION)), T.StructField("calls", T.DataType.fromDDL("ARRAY<STRING>"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in out.fields[-2:]]
        for b in batches:
            text = [t or "" for t in b.column(source).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([functions(t) for t in text], kinds[0]), pa.array([calls(t) for t in text], kinds[1])], names=out.names)

    return df.mapInArrow(run, out)


#: A class that is always kept, one that is kept where a symmetry is detected, and classes that are kept where they are named.
ALWAYS, SYMMETRY = "Color", "Symmetry"
DETECTORS = ["detect_rotational_symmetry", "detect_translational_symmetry", "detect_mirror_symmetry"]
NAMED = ["RotationalSymmetry", "TranslationalSymmetry", "MirrorSymmetry"]


def pruned_library(library: DataFrame, programs: DataFrame) -> DataFrame:
    """Library functions that some program calls, and, where `kind` tells them apart, its classes by rule, internal ones left out. library: (name, docstring, ...); programs: with `calls`, and for classes `content`."""
    calls = programs.select(F.explode("calls").alias("name")).distinct()
    shown = ~F.coalesce(F.contains(F.lower("docstring"), F.lit("internal")), F.lit(False))
    if "kind" not in library.columns:
        return library.join(calls, "name", "left_semi").filter(shown)
    detects = calls.filter(F.col("name").isin(DETECTORS)).limit(1).select(F.lit(SYMMETRY).alias("name"))
    named = programs.select(F.explode(F.filter(F.array(*[F.lit(n) for n in NAMED]), lambda n: F.contains("content", n))).alias("name")).distinct()
    always = programs.sparkSession.createDataFrame([(ALWAYS,)], "name string")
    classes = always.unionByName(detects).unionByName(named).distinct()
    is_class = F.coalesce(F.col("kind") == "class", F.lit(False))
    return library.filter(~is_class).join(calls, "name", "left_semi").unionByName(library.filter(is_class).join(classes, "name", "left_semi")).filter(shown)


def usage_histogram(library: DataFrame, programs: DataFrame) -> DataFrame:
    """(name, programs): how many programs call each library function."""
    used = programs.select(F.explode(F.array_distinct("calls")).alias("name")).groupBy("name").agg(F.count("*").alias("programs"))
    return library.select("name").distinct().join(used, "name", "left").select("name", F.coalesce("programs", F.lit(0)).alias("programs"))
