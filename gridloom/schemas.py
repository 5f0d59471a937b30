"""Data model: declared types for every record kind, so that no reader has to infer one."""

from __future__ import annotations

from pyspark.sql import types as T


_ATOMS = {"STRING": T.StringType(), "INT": T.IntegerType(), "LONG": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType()}


def _split(text: str) -> list[str]:
    """At commas outside angle brackets."""
    depth, parts = 0, [""]
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return [p.strip() for p in parts if p.strip()]


def kind(text: str) -> T.DataType:
    """A type from its SQL name; unlike Spark's own parser it needs no session."""
    name, _, inner = text.strip().partition("<")
    if not inner:
        return _ATOMS[name.upper()]
    inner = inner.rpartition(">")[0]
    if name.upper() == "ARRAY":
        return T.ArrayType(kind(inner))
    return T.StructType([T.StructField(n.strip(), kind(t)) for n, _, t in (p.partition(":") for p in _split(inner))])


def ddl(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, kind(t)) for n, _, t in (p.partition(" ") for p in _split(text))])


GRID = "ARRAY<ARRAY<INT>>"
PAIR = f"STRUCT<input:{GRID}, output:{GRID}>"
MESSAGE = "STRUCT<role:STRING, content:STRING>"

PROBLEM = ddl(f"uid STRING, source STRING, examples ARRAY<{PAIR}>, seeds ARRAY<STRING>")
TASK = ddl(f"uid STRING, train ARRAY<{PAIR}>, test ARRAY<{PAIR}>")
SEED = ddl("seed_id STRING, content STRING")
DESCRIPTION = ddl(
    "concepts STRING, description STRING, scenario STRING, objects ARRAY<STRING>, composite_objects ARRAY<STRING>, static_patterns ARRAY<STRING>, "
    "dynamic_patterns ARRAY<STRING>, interactions ARRAY<STRING>, core_principles ARRAY<STRING>, fundamental_principle STRING, similar_situations ARRAY<STRING>, "
    "visual_elements ARRAY<STRING>, gif_path STRING, intergrated BOOLEAN"
)
CODE = ddl("code ARRAY<STRING>, seeds ARRAY<STRING>")
CHAT = ddl(f"messages ARRAY<{MESSAGE}>")
PREFERENCE = ddl(f"prompt ARRAY<{MESSAGE}>, chosen ARRAY<{MESSAGE}>, rejected ARRAY<{MESSAGE}>")
RESPONSE = ddl("uid STRING, prompt STRING, responses ARRAY<STRING>, base_model STRING, lora_dir STRING")
VERDICT = ddl(
    "uid STRING, prompt STRING, responses ARRAY<STRING>, base_model STRING, lora_dir STRING, train_verdicts ARRAY<BOOLEAN>, "
    f"train_test_verdicts ARRAY<BOOLEAN>, output_grids ARRAY<ARRAY<{GRID}>>, verdicts_per_examples ARRAY<ARRAY<BOOLEAN>>"
)
EMBEDDING = ddl("key STRING, embedding ARRAY<FLOAT>")
LEDGER = ddl(
    "id STRING, step_name STRING, prev_step_id STRING, gif_id STRING, gen_model STRING, result_code INT, result_path STRING, "
    "error_message STRING, created_at TIMESTAMP, token_usage STRING, visualization_path STRING"
)
ERROR_LOG = ddl("time STRING, error_type STRING, server_response STRING, status_code STRING, gif_name STRING, model STRING, temperature STRING, max_tokens STRING")
CHECK_COUNTS = ddl("reason STRING, n LONG")
ANNOTATED = ddl(f"uid STRING, annotations STRUCT<example:STRING, code:STRING>, metadata STRUCT<source_file:STRING>, examples ARRAY<{PAIR}>, code STRING")
HISTORY = ddl("conv_id LONG, turn LONG, role STRING, content STRING")
SYMMETRY = ddl("kind STRING, a DOUBLE, b DOUBLE")
#: A program's result; errors never stand in a grid's place.
OUTCOME = ddl(f"status STRING, grid {GRID}, error STRING")

#: Colours of cells 0 to 9 by their names in programs, and by their names for models.
COLORS = ["BLACK", "BLUE", "RED", "GREEN", "YELLOW", "GREY", "PINK", "ORANGE", "TEAL", "MAROON"]
MODEL_COLORS = ["Black", "Blue", "Red", "Green", "Yellow", "Gray", "Pink", "Orange", "Purple", "Brown"]
#: Other spellings of the models' names.
ALIASES = {"GREY": 5}
LARGEST = 30
