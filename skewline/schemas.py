"""Explicit schemas of the engine's tables; nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

_LONG, _DOUBLE, _BOOL, _STRING = T.LongType(), T.DoubleType(), T.BooleanType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


#: What a rank reports of a step; predicted_cost is absent from older files.
RANK_METRICS = _struct(rank=_LONG, step=_LONG, warmup=_BOOL, local_tokens=_LONG, global_tokens=_LONG, padded_tokens=_LONG, step_ms=_DOUBLE, loss_sum=_DOUBLE, peak_memory_bytes=_LONG, predicted_cost=_DOUBLE)
REQUIRED_METRICS = tuple(RANK_METRICS.names[:-1])

PROGRESS = _struct(schema_version=_LONG, rank=_LONG, start_step=_LONG, last_step=_LONG, rows=_LONG, bytes=_LONG, sha256=_STRING, flushes=_LONG, complete=_BOOL)
HARDWARE = _struct(rank=_LONG, hostname=_STRING, platform=_STRING, torch=_STRING, gpu=_STRING, cuda_runtime=_STRING, backend=_STRING, source_sha256=_STRING, device=_STRING, planning_wall_ms=_DOUBLE, training_wall_ms=_DOUBLE)
MANIFEST = T.StructType(
    [
        *_struct(schema_version=_LONG, evidence=_STRING, world_size=_LONG, timing=_STRING, instrumented=_BOOL, start_step=_LONG, resume=_STRING).fields,
        T.StructField("config", T.MapType(_STRING, _STRING)),
        T.StructField("hardware", T.ArrayType(HARDWARE)),
        T.StructField("telemetry", _struct(flush_every=_LONG, rank_progress=T.ArrayType(PROGRESS))),
        T.StructField("fleet", T.MapType(_STRING, _STRING)),
        T.StructField("dataset", T.MapType(_STRING, _STRING)),
    ]
)
TRACE_EVENT = _struct(ph=_STRING, name=_STRING, cat=_STRING, ts=_DOUBLE, dur=_DOUBLE, pid=_LONG, tid=_LONG, args=_struct(device=_LONG))
RANK_MODEL = _struct(rank=_LONG, quadratic=_DOUBLE, linear=_DOUBLE, overhead=_DOUBLE, max_samples=_LONG, max_padded_tokens=_LONG, max_attention_cells=_LONG)
CALIBRATION = _struct(rank=_LONG, batch=_LONG, width=_LONG, repeat=_LONG, ms=_DOUBLE)
SPAN = _struct(rank=_LONG, kind=_STRING, s=_DOUBLE, e=_DOUBLE)
DOMAIN = _struct(rank=_LONG, min_batch=_LONG, max_batch=_LONG, min_width=_LONG, max_width=_LONG)
#: Cost profiles of fleets; the workload stays a text, since only its equality counts.
PROFILE = T.StructType(
    [
        *_struct(schema_version=_LONG, evidence=_STRING, units=_STRING, scope=_STRING, workload=_STRING).fields,
        T.StructField("hardware", T.ArrayType(T.MapType(_STRING, _STRING))),
        T.StructField("ranks", T.ArrayType(_struct(model=T.StructType(RANK_MODEL.fields[1:]), domain=T.StructType(DOMAIN.fields[1:])))),
    ]
)
CORPUS_INDEX = _struct(sample_id=_LONG, doc=_LONG, offset=_LONG, length=_LONG)
CHECKPOINT_FILE = _struct(path=_STRING, bytes=_LONG, sha256=_STRING)
CHECKPOINT = T.StructType(
    [
        *_struct(schema_version=_LONG, step=_LONG, world_size=_LONG, torch_version=_STRING, fleet_sha256=_STRING, dataset_sha256=_STRING, model_contract_sha256=_STRING, sha256=_STRING).fields,
        T.StructField("config", T.MapType(_STRING, _STRING)),
        T.StructField("files", T.ArrayType(CHECKPOINT_FILE)),
    ]
)
STATE = _struct(path=_STRING, index=_LONG, value=_DOUBLE)
EVIDENCE = ("observed", "synthetic", "declared", "observed_isolated", "analytic_proxy", "observed_cpu")
