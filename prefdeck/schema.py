"""Column layouts shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# One JSON object per line. Never inferred: inference turns ``rank`` into a struct with one field
# per response id. ``annotations`` keeps the raw JSON of each element, so that one scan takes both
# the object form and the array form.
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("input", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("sys_prompt", T.StringType()),
        T.StructField("category", T.ArrayType(T.StringType())),
        T.StructField("answer1", T.StringType()),
        T.StructField("answer2", T.StringType()),
        T.StructField("preference", T.StringType()),
        T.StructField(
            "responses",
            T.ArrayType(
                T.StructType(
                    [T.StructField("id", T.StringType()), T.StructField("content", T.StringType())]
                )
            ),
        ),
        T.StructField("annotations", T.ArrayType(T.StringType())),
        T.StructField("rank", T.MapType(T.StringType(), T.StringType())),
    ]
)

CORRUPT = "_corrupt_record"

# Position of a record in its load: listed path, byte offset of the split, row inside the scan.
# (path, block) is the chunk used by the numbering operators: one file split, so bounded.
ORD_TYPE = "struct<path:int,block:bigint,row:bigint>"

# Fixed value: marks padding in exported label arrays.
IGNORE_ID = -100

# The key of a prompt inside one fused data set.
PROMPT_KEY = ["input_key", "origin"]
