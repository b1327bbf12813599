"""The tables' schemas. Each field's metadata says which stage sets it and whether a learner may move it; it survives select, filter and parquet."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

S, D, I, B, L = StringType(), DoubleType(), IntegerType(), BooleanType(), LongType()


def field(name: str, kind: DataType, stage: str = "ingest", origin: str = "deterministic", learnable: bool = False) -> StructField:
    return StructField(name, kind, True, {"stage": stage, "origin": origin, "learnable": learnable})


def struct(*fields: StructField) -> StructType:
    return StructType(list(fields))


POINT = struct(field("x", D), field("y", D))
WORD = struct(field("t_in", D, "transcribe"), field("t_out", D, "transcribe"), field("text", S, "transcribe", "model"), field("emphasis", B, "emphasis", "model"))
REMOVALS = struct(field("job_id", S), field("t_in", D, "trim"), field("t_out", D, "trim"), field("kind", S, "trim"), field("proposed_by", S, "edit", "model"))
SEGMENTS = struct(field("job_id", S), field("t_in", D, "edit", "model"), field("t_out", D, "edit", "model"), field("tier", S, "edit", "model"), field("reason", S, "edit", "model"))
FOCUS_POINTS = struct(field("job_id", S), field("t", D), field("x", D), field("y", D), field("weight", D), field("kind", S))
CAPTIONS = struct(field("job_id", S), field("block_ix", I, "captions"), field("t_in", D, "captions"), field("t_out", D, "captions"), field("words", ArrayType(WORD), "captions"))
OVERLAYS = struct(field("job_id", S), field("ix", I, "overlays"), field("template", S, "overlays", "model"), field("text", S, "overlays", "model"), field("anchor", POINT, "overlays"), field("t_in", D, "overlays"), field("t_out", D, "overlays"))
SOURCE = struct(field("source_id", S), field("provenance", S), field("path", S), field("events_path", S), field("duration", D), field("width", I), field("height", I), field("fps", D), field("has_audio", B))
SPECS = struct(field("job_id", S), field("spec_version", I), field("created_at", TimestampType()), field("source", SOURCE))
AUDIO = struct(*(field(n, D, "audio", learnable=n in ("music_gain_db", "duck_db")) for n in ("narration_gain_db", "music_gain_db", "duck_db", "target_lufs", "true_peak_ceiling_dbtp")), field("music_path", S, "audio"))
JOBS = struct(field("job_id", S), field("status", S), field("spec_version", I), field("job_dir", S), field("degradations", S), field("created_at", TimestampType()), field("updated_at", TimestampType()))
VERIFICATIONS = struct(field("id", L), field("job_id", S), field("profile", S), field("passed", B), field("findings_json", S), field("created_at", TimestampType()))
STAGE_CACHE = struct(field("cache_key", S), field("job_id", S), field("stage", S), field("stage_version", I), field("profile", S), field("path", S), field("created_at", TimestampType()))
#: profile_json is null in rows from before it was kept.
ACCEPTED_SPECS = struct(field("id", L), field("job_id", S), field("profile", S), field("spec_json", S), field("accepted_at", TimestampType()), field("profile_json", S))
PREF_CHANGES = struct(field("id", L), field("profile", S), field("key", S), field("old_value", S), field("new_value", S), field("caused_by", S), field("changed_at", TimestampType()))
REVIEWS = struct(field("id", L), field("job_id", S), field("decision", S), field("diff_json", S), field("created_at", TimestampType()))
FINDINGS = struct(field("job_id", S, "verify"), field("check", S, "verify"), field("severity", S, "verify"), field("message", S, "verify"), field("value", D, "verify"), field("limit", D, "verify"))

#: What recorders and recognisers leave.
PIXEL_EVENTS = StructType().add("width", I).add("height", I).add("duration", D).add("samples", ArrayType(StructType().add("t", D).add("x", D).add("y", D))).add("clicks", ArrayType(D))
CURSOR = StructType().add("moves", ArrayType(StructType().add("time_ms", D).add("x", D).add("y", D))).add("clicks", ArrayType(StructType().add("time_ms", D).add("down", B)))
ASR = StructType().add("transcription", ArrayType(StructType().add("offsets", StructType().add("from", L).add("to", L)).add("text", S)))
HOST = "cpu STRING, cores STRING, memory_gb DOUBLE, os STRING, arch STRING, python STRING, ffmpeg STRING, measured_at STRING"
AGENT_EVENT = "type STRING, message STRUCT<role: STRING, content: ARRAY<STRUCT<type: STRING, text: STRING>>>"


def leaves(kind: DataType, path: str = "", only_learnable: bool = False) -> list[tuple[str, StructField | None]]:
    """Every leaf's dotted path ([] for array elements) with its field, in order of declaration."""
    if isinstance(kind, StructType):
        out = []
        for f in kind.fields:
            for p, leaf in leaves(f.dataType, f"{path}.{f.name}" if path else f.name):
                out.append((p, leaf or f))
        return [x for x in out if not only_learnable or (x[1].metadata or {}).get("learnable")]
    if isinstance(kind, ArrayType):
        return leaves(kind.elementType, f"{path}[]")
    return [(path, None)]
