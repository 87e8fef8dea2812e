"""Table layouts and the fixed values of the profile data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Event origins.
SAMPLING, OFF_CPU, MEMORY, CUDA, GPU_PC, PROBE = "sampling", "off_cpu", "memory", "cuda", "gpu_pc", "probe"

# Sampling defaults.
SAMPLES_PER_SECOND = 19
SECOND_NS = 1_000_000_000
MEMORY_PERIOD = 512 * 1024
LABEL_TTL_NS = 600 * SECOND_NS
CUSTOM_LABEL_MAX_LEN = 48

# The producer written on CPU, off-CPU and GPU samples. Stores that expect the name of a
# particular agent get it through the ``producer`` parameter of the operators.
PRODUCER = "agent"

LABELS = T.MapType(T.StringType(), T.StringType())

FRAME = T.StructType([
    T.StructField("frame_type", T.StringType()),
    T.StructField("address", T.LongType()),
    T.StructField("file_id", T.StringType()),
    T.StructField("gnu_build_id", T.StringType()),
    T.StructField("mapping_file_name", T.StringType()),
    T.StructField("function_name", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("source_line", T.LongType()),
    T.StructField("source_column", T.LongType()),
])

MEMORY_STATS = T.StructType([
    T.StructField("allocs", T.LongType()),
    T.StructField("frees", T.LongType()),
    T.StructField("alloc_bytes", T.LongType()),
    T.StructField("free_bytes", T.LongType()),
])

TRACE_EVENT = T.StructType([
    T.StructField("ts_ns", T.LongType()),
    T.StructField("node", T.StringType()),
    T.StructField("pid", T.LongType()),
    T.StructField("tid", T.LongType()),
    T.StructField("cpu", T.IntegerType()),
    T.StructField("comm", T.StringType()),
    T.StructField("origin", T.StringType()),
    T.StructField("raw_value", T.LongType()),
    T.StructField("env", LABELS),
    T.StructField("custom_labels", T.MapType(T.BinaryType(), T.BinaryType())),
    T.StructField("mem", MEMORY_STATS),
    T.StructField("frames", T.ArrayType(FRAME)),
])

LINE = T.StructType([
    T.StructField("line", T.LongType()),
    T.StructField("column", T.LongType()),
    T.StructField("function_system_name", T.StringType()),
    T.StructField("function_name", T.StringType()),
    T.StructField("function_filename", T.StringType()),
    T.StructField("function_start_line", T.LongType()),
])

LOCATION = T.StructType([
    T.StructField("address", T.LongType()),
    T.StructField("frame_type", T.StringType()),
    T.StructField("mapping_file", T.StringType()),
    T.StructField("mapping_build_id", T.StringType()),
    T.StructField("lines", T.ArrayType(LINE)),
])

# The fixed columns of a sample, after the labels.
SAMPLE_COLUMNS = [
    "stacktrace_id", "ts_ns", "value", "sample_type", "sample_unit", "period_type", "period_unit",
    "producer", "temporality", "period", "duration",
]
