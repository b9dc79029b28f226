"""Evaluation from data to scores: prompts are loaded, a model is asked through a ledger, its answers are scored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import flatten_newlines, upper_first
from .evaluate import accuracy_rows, scored
from .ledger import Call, Ledger
from .models import MODELS

#: What a model is asked about an image, and how its answer begins.
QUESTION = "Describe the image in detail. If you see text or objects, describe them in detail, as well as all other aspects of the foreground and background."
OPENING = "The image shows "


def caption_call(model: str) -> Call:
    """Rows with image and lang."""

    def make():
        m = MODELS[model]()

        def run(rows: list[dict]) -> list[str]:
            out: list[str | None] = [None] * len(rows)
            for lang in sorted({r["lang"] for r in rows}):  # a model takes one language at a time
                at = [i for i, r in enumerate(rows) if r["lang"] == lang]
                for i, x in zip(at, m.caption(m.process_batch_caption([rows[i]["image"] for i in at], lang), lang), strict=True):
                    out[i] = x
            return out

        return run

    return Call(f"{model}.caption", make, ["image", "lang"])


def translation_call(model: str) -> Call:
    """Rows with image, lang and source."""

    def make():
        m = MODELS[model]()

        def run(rows: list[dict]) -> list[str]:
            out: list[str | None] = [None] * len(rows)
            for lang in sorted({r["lang"] for r in rows}):
                at = [i for i, r in enumerate(rows) if r["lang"] == lang]
                images, sources = m.process_batch_translation([rows[i]["image"] for i in at], lang, [rows[i]["source"] for i in at])
                for i, x in zip(at, m.translate(images, lang, sources), strict=True):
                    out[i] = x
            return out

        return run

    return Call(f"{model}.translate", make, ["image", "lang", "source"])


def perplexity_call(model: str) -> Call:
    """Rows with image, lang, source and target; the answer is a number as text."""

    def make():
        m = MODELS[model]()

        def run(rows: list[dict]) -> list[str]:
            out: list[str | None] = [None] * len(rows)
            for lang in sorted({r["lang"] for r in rows}):
                at = [i for i, r in enumerate(rows) if r["lang"] == lang]
                batch = m.process_batch_lexical_ambiguity(*([rows[i][k] for i in at] for k in ("image", "source", "target")), lang)
                for i, x in zip(at, m.perplexity(batch[0], lang, batch[1], batch[2]), strict=True):
                    out[i] = repr(float(x))
            return out

        return run

    return Call(f"{model}.perplexity", make, ["image", "lang", "source", "target"])


def description_call(model: str) -> Call:
    """Rows with image: what the model says to QUESTION after OPENING, which its answer begins with."""

    def make():
        m = MODELS[model]()
        return lambda rows: [m.answer(r["image"], QUESTION, OPENING) for r in rows]

    return Call(f"{model}.describe", make, ["image"], {"question": QUESTION, "opening": OPENING})


def described(images: DataFrame, model: str, ledger: Ledger, out: str = "description") -> DataFrame:
    """images (image and others) with a description on one line that begins with a capital."""
    got = ledger.called(images, description_call(model), out)
    return got.withColumn(out, upper_first(flatten_newlines(F.col(out))))


def evaluated(data: DataFrame, model: str, ledger: Ledger, comet: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """task, metric, value of a model on data.

    data: task, idx, image, lang, source, references, and for lexical ambiguity incorrect (the first reference is the
    correct text). Captions, translations and perplexities are asked for through the ledger, so that a second run
    scores without a call.
    """
    kind = F.when(F.col("task").contains("lexical_ambiguity"), "ambiguity").when(F.col("task").contains("translation"), "translation").otherwise("caption")
    rows = data.withColumn("__kind", kind)
    captions = ledger.called(rows.where("__kind = 'caption'"), caption_call(model), "prediction")
    texts = ledger.called(rows.where("__kind = 'translation'"), translation_call(model), "prediction")
    both = captions.unionByName(texts).select("task", "idx", "source", F.coalesce("prediction", F.lit("")).alias("prediction"), "references")
    tasks = sorted(r.task for r in both.select("task").distinct().collect())  # some tens
    out = scored(both, tasks, comet=comet) if tasks else None
    pairs = rows.where("__kind = 'ambiguity'")
    call = perplexity_call(model)
    one = pairs.select("task", "idx", "image", "lang", "source", F.posexplode(F.array(F.get("references", F.lit(0)), "incorrect")).alias("place", "target"))
    told = ledger.called(one, call, "value")
    sides = told.groupBy("task", "idx").agg(F.max(F.when(F.col("place") == 0, F.col("value").cast("double"))).alias("correct"), F.max(F.when(F.col("place") == 1, F.col("value").cast("double"))).alias("incorrect"))
    found = accuracy_rows(sides)
    return found if out is None else out.union(found)
