"""Which stages of a document's pipeline have to run again: keys that cover what a stage reads and the keys of the stages before it.

A changed column gives new keys to the stages that read it and to all that follow these, and to nothing else. Keys are made in one projection, stage after stage in an order in which
each comes after what it depends on, so that a change spreads along the graph without a join; a document is one row throughout.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..sources.recordings import content_key


@dataclass(frozen=True)
class Stage:
    """reads: columns, or the beginnings of names that end in *. after: what other stages provide; with_: the same, where a recipe has it."""

    reads: tuple[str, ...]
    after: tuple[str, ...] = ()
    with_: tuple[str, ...] = ()
    provides: str = ""
    version: int = 1
    model: bool = False


_SPEC = ("source_*", "focus", "narration_*", "edit", "captions", "overlays", "audio")
#: The stages, what each reads and follows (fixed values). The first nine run once for a job, the others once for each profile.
STAGES = {
    "script_draft": Stage(("narration_brief", "source_duration", "focus"), provides="script", model=True),
    "transcribe": Stage(("source_digest", "source_has_audio", "asr"), provides="transcript"),
    "tts": Stage(("narration_script", "narration_voice_digest", "narration_voice_text", "tts"), with_=("script",), provides="narration"),
    "align": Stage(("narration_script", "asr"), after=("narration",), provides="transcript"),
    "plan_captions": Stage(("capacity", "pause"), after=("transcript",), provides="captions"),
    "emphasis": Stage(("suggested_share",), after=("captions",), model=True),
    "trim": Stage(("narration_digest", "trim"), after=("transcript",)),
    "plan_edit": Stage(("focus", "source_duration"), after=("transcript", "trim"), model=True),
    "plan_overlays": Stage(("focus", "source_duration", "min_span"), after=("transcript",), model=True),
    "plan_focus": Stage(("source_width", "source_height", "source_fps", "source_duration", "focus", "profile_width", "profile_height", "profile_fps", "profile_focus")),
    "compile": Stage((*_SPEC, "profile_width", "profile_height", "profile_fps", "profile_focus", "profile_budget"), after=("plan_focus",)),
    "render": Stage(("source_digest", "narration_digest", "audio", "profile_encode", "encoder", "graph_option"), after=("compile",)),
    "verify_transcript": Stage(("edit", "profile_budget"), after=("render",), with_=("transcript",)),
    "verify": Stage((*_SPEC, "profile_*"), after=("plan_focus", "compile", "render"), with_=("verify_transcript", "trim")),
    "metadata": Stage(("profile_name", "profile_width", "profile_height", "spoken", "narration_script", "source_duration"), model=True),
}
_PLANNED = ("plan_captions", "emphasis", "trim", "plan_edit", "plan_overlays")
_FOR_PROFILE = ("plan_focus", "compile", "render", "verify_transcript", "verify", "metadata")
#: Which stages a job has, in the order in which they run (fixed values).
RECIPES = {
    "recorded": ("transcribe", *_PLANNED, *_FOR_PROFILE),
    "synthesized": ("tts", "align", *_PLANNED, *_FOR_PROFILE),
    "drafted": ("script_draft", "tts", "align", *_PLANNED, *_FOR_PROFILE),
}


def _columns(docs: DataFrame, names: tuple[str, ...]) -> list[str]:
    """The columns of docs that these names stand for; columns that a table hasn't are not read."""
    return sorted({c for c in docs.columns for n in names if c == n or (n.endswith("*") and c.startswith(n[:-1]))})


def _keyed(docs: DataFrame, recipe: str, stages: dict[str, Stage]) -> tuple[DataFrame, tuple[str, ...]]:
    """docs with __key_ and __own_ of each stage of a recipe, and the stages in order."""
    out, provided, order = docs, {}, RECIPES.get(recipe, tuple(stages))
    for name in order:
        stage = stages[name]
        missing = [x for x in stage.after if x not in provided]
        if missing:
            raise ValueError(f"{name} comes before {missing[0]}, which it follows")
        own = _columns(docs, stage.reads)
        params = _columns(docs, ("model_*",)) if stage.model else []
        before = [provided[x] for x in (*stage.after, *stage.with_) if x in provided]
        key = lambda inputs: content_key(F.lit(name), F.lit(stage.version), inputs or [F.lit(0).alias("none")], params or [F.lit(0).alias("none")])  # noqa: E731, B023
        out = out.withColumns({f"__key_{name}": key([*own, *before]), f"__own_{name}": key(own)})
        provided[stage.provides or name] = f"__key_{name}"
    return out, order


def keys(docs: DataFrame, recipe: str, by: tuple[str, ...] = ("job_id",), stages: dict[str, Stage] = STAGES) -> DataFrame:
    """by, stage, cache_key, own_key for each stage of a recipe; own_key covers what the stage reads itself and not what came before. A model's stages cover the columns model_* as parameters."""
    out, order = _keyed(docs, recipe, stages)
    each = [F.struct(F.lit(n).alias("stage"), F.col(f"__key_{n}").alias("cache_key"), F.col(f"__own_{n}").alias("own_key")) for n in order]
    return out.select(*by, F.explode(F.array(*each)).alias("s")).select(*by, "s.*")


def stale(before: DataFrame, now: DataFrame, recipe: str, by: tuple[str, ...] = ("job_id",), stages: dict[str, Stage] = STAGES) -> DataFrame:
    """by, stage, own of the stages whose key is another one than before: own if something that the stage itself reads has changed, not only
    something before it. All stages of a new document are stale; documents that are gone have none. by must name one document, in both tables.

    Documents meet as one row with the columns that are read; keys, which are longer and of which there are many, are made beside each other after that and never travel.
    """
    names = [f"__by{i}" for i in range(len(by))]

    def held(docs: DataFrame, side: str) -> DataFrame:
        reads = [r for n in RECIPES.get(recipe, tuple(stages)) for r in (*stages[n].reads, *(("model_*",) if stages[n].model else ()))]
        whole = F.struct(F.lit(True).alias("__there"), *_columns(docs, tuple(reads)))
        return docs.select(*(F.col(c).alias(f"{n}{side}") for c, n in zip(by, names)), whole.alias(f"__{side}"))

    same = reduce(lambda x, y: x & y, (F.col(f"{n}now").eqNullSafe(F.col(f"{n}was")) for n in names))
    j = held(now, "now").join(held(before, "was"), same, "left").select(*(F.col(f"{n}now").alias(n) for n in names), "__now", "__was")
    new, order = _keyed(j.select(*names, "__was", "__now.*").drop("__there"), recipe, stages)
    new = new.select(*names, "__was", F.struct(*(F.col(f"__{k}_{n}").alias(f"{k}_{n}") for n in order for k in ("key", "own"))).alias("__new"))
    old, _ = _keyed(new.select(*names, "__new", "__was.*"), recipe, stages)
    differs = lambda key: F.col("__there").isNull() | (F.col(f"__new.{key}") != F.col(f"__{key}"))
    each = F.array(*(F.when(differs(f"key_{n}"), F.struct(F.lit(n).alias("stage"), differs(f"own_{n}").alias("own"))) for n in order))
    found = old.select(*names, F.explode(F.array_compact(each)).alias("s"))
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, by)), "s.*")
