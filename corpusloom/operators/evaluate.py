"""Evaluation tasks, their scores and the report tables over them.

Predictions are one table (task, idx, source, prediction, references); scores come out as metric
rows (task, metric, value).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import metric_tokens, nfkc, nfkc_each
from ..functions.vectors import clip_score
from . import metrics as M
from . import report as T
from .meteor import meteor

# The tasks by kind, and the sets to run.
TASKS: dict[str, list[str]] = {
    "caption": ["multi30k_caption_test_2016_en", "multi30k_caption_test_2016_de", "xm3600_caption_en", "xm3600_caption_de", "xm3600_caption_fr", "xm3600_caption_es", "xm3600_caption_ru", "xm3600_caption_zh", "coco_karpathy_caption"],
    "translation": ["multi30k_translation_test_2016_flickr_de", "multi30k_translation_test_2016_flickr_fr", "multi30k_translation_test_2017_flickr_de", "multi30k_translation_test_2017_flickr_fr", "multi30k_translation_test_2018_flickr_de", "multi30k_translation_test_2018_flickr_fr", "multi30k_translation_test_2017_mscoco_de", "multi30k_translation_test_2017_mscoco_fr", "commute_translation_de", "commute_translation_fr", "commute_translation_ru", "commute_translation_zh"],
    "ambiguity": ["commute_lexical_ambiguity_de", "commute_lexical_ambiguity_fr", "commute_lexical_ambiguity_ru", "commute_lexical_ambiguity_zh"],
    "en_caption": ["multi30k_caption_test_2016_en", "xm3600_caption_en", "coco_karpathy_caption"],
}
#: Languages METEOR is reported for.
METEOR_LANGS = ("cz", "de", "en", "es", "fr")
# Report tables as (title, task prefix, keys, metrics, mean over keys).
REPORTS: list[tuple[str, str, list[str], list[str], bool]] = [
    ("translation to de", "multi30k_translation_", ["test_2016_flickr_de", "test_2017_flickr_de", "test_2018_flickr_de", "test_2017_mscoco_de"], ["SacreBLEU", "COMET"], False),
    ("translation to fr", "multi30k_translation_", ["test_2016_flickr_fr", "test_2017_flickr_fr", "test_2018_flickr_fr", "test_2017_mscoco_fr"], ["SacreBLEU", "COMET"], False),
    ("mean translation to de", "multi30k_translation_", ["test_2016_flickr_de", "test_2017_flickr_de", "test_2017_mscoco_de"], ["SacreBLEU", "COMET"], True),
    ("mean translation to fr", "multi30k_translation_", ["test_2016_flickr_fr", "test_2017_flickr_fr", "test_2017_mscoco_fr"], ["SacreBLEU", "COMET"], True),
    ("ambiguous translation", "commute_translation_", ["de", "fr", "ru", "zh"], ["SacreBLEU", "COMET"], False),
    ("mean ambiguous translation", "commute_translation_", ["de", "fr", "ru", "zh"], ["SacreBLEU"], True),
    ("lexical ambiguity", "commute_lexical_ambiguity_", ["de", "fr", "ru", "zh"], ["accuracy"], False),
    ("mean lexical ambiguity", "commute_lexical_ambiguity_", ["de", "fr", "ru", "zh"], ["accuracy"], True),
    ("captions in en", "multi30k_caption_test_2016_", ["en"], ["BLEU_4", "CIDEr", "CLIPScore"], False),
    ("captions in de", "multi30k_caption_test_2016_", ["de"], ["BLEU_4", "CIDEr", "MCLIPScore"], False),
    ("multilingual captions", "xm3600_caption_", ["en", "de", "fr", "es", "ru", "zh"], ["XM3600_CIDEr"], False),
    ("mean multilingual captions", "xm3600_caption_", ["fr", "es", "ru", "zh"], ["XM3600_CIDEr"], True),
    ("English captions", "", ["coco_karpathy_caption"], ["BLEU_4", "CIDEr", "CLIPScore"], False),
]


def task_set(name: str) -> list[str]:
    """Tasks of a named set; full is translation, caption and ambiguity."""
    if name == "full":
        return [*TASKS["translation"], *TASKS["caption"], *TASKS["ambiguity"]]
    if name not in TASKS:
        raise ValueError(f"no such task set: {name}")
    return TASKS[name]


#: Chinese, Japanese and Korean signs and full-width forms, which the published tokenizer sets apart.
CJK = r"([\u2e80-\u2fdf\u2ff0-\u303f\u3100-\u312f\u31a0-\u31bf\u31c0-\u31ef\u3200-\u4db5\u4e00-\u9fff\uf900-\ufaff\ufe10-\ufe1f\ufe30-\ufe4f\uff00-\uffef])"


def tokens_zh(c: Column) -> Column:
    """Tokens of the published metric for Chinese: each Chinese sign by itself, all else as tokens_13a has it, so that
    Latin words and numbers stay whole."""
    return M.tokens_13a(F.regexp_replace(c, CJK, " $1 "))


def _bleu(df: DataFrame, lang: str) -> dict[str, DataFrame]:
    b = M.bleu(df, tokens_zh if lang == "zh" else M.tokens_13a)
    return {"SacreBLEU": b.select(F.col("bleu").alias("value"))}


def _hf_bleu(df: DataFrame, lang: str) -> dict[str, DataFrame]:
    """Without smoothing: no match in an order gives 0."""
    sums = M.bleu_sums(df, M.tokens_13a).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in M.BLEU_SUMS))
    whole = F.least(*(f"match{n}" for n in range(1, M.ORDER + 1))) > 0
    score = M.bleu_of(sums).select("bleu")
    return {"HfBLEU": sums.select(whole.alias("whole")).crossJoin(score).select(F.when(F.col("whole"), F.col("bleu")).otherwise(0.0).alias("value"))}  # one row each


def _orders(df: DataFrame, lang: str) -> dict[str, DataFrame]:
    b = M.bleu(df)
    out, ps = {}, [F.col(f"p{n}") for n in range(1, 5)]
    for n in range(1, 5):
        part = ps[:n]
        mean = F.when(F.least(*part, F.lit(100.0)) <= 0, 0.0).otherwise(F.exp(sum((F.ln(p) for p in part), F.lit(0.0)) / n))
        out[f"BLEU_{n}"] = b.select((F.col("brevity") * mean).alias("value"))
    return out


def _cider(name: str, tokenizer: Callable[[Column], Column], digits: int | None = None) -> Callable[[DataFrame, str], dict[str, DataFrame]]:
    def score(df: DataFrame, lang: str) -> dict[str, DataFrame]:
        value = F.avg("cider") * 100
        return {name: M.cider(df, tokenizer).agg((value if digits is None else F.bround(value, digits)).alias("value"))}

    return score


def _meteor(df: DataFrame, lang: str) -> dict[str, DataFrame]:
    return {"METEOR": meteor(df, lang).agg((F.avg("meteor") * 100).alias("value"))} if lang in METEOR_LANGS else {}


def _clip(df: DataFrame, lang: str) -> dict[str, DataFrame]:
    """Where rows have vectors of the image and of the prediction, by one encoder or by a multilingual one."""
    out = {}
    for metric, image, text in (("CLIPScore", "image_vector", "text_vector"), ("MCLIPScore", "image_mvector", "text_mvector")):
        if image in df.columns and text in df.columns:
            out[metric] = df.agg((F.avg(clip_score(F.col(image), F.col(text))) * 100).alias("value"))
    return out


def scorers(task: str) -> list[Callable[[DataFrame, str], dict[str, DataFrame]]]:
    """What a task is scored by."""
    if task.startswith("xm3600"):
        lang = F.lit(task.rpartition("_")[2])
        cider = _cider("XM3600_CIDEr", lambda c: metric_tokens(c, lang), 1)
        # Python can't run inside a lambda over the references, so texts are normalised before
        return [lambda df, code: cider(df.withColumns({"prediction": nfkc(F.col("prediction")), "references": nfkc_each(F.col("references"))}), code), _clip]
    if "translation" in task:
        return [_bleu, _meteor, _hf_bleu]
    return [_orders, _cider("CIDEr", M.tokens), _meteor, _clip]


VECTORS = ("image_vector", "text_vector", "image_mvector", "text_mvector")


def scored(predictions: DataFrame, tasks: list[str], comet: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """task, metric, value of metrics; one aggregation a task and metric.

    predictions: task, idx, source, prediction, references, and any of VECTORS for CLIP scores. comet: gets (id, source,
    prediction, reference) of a translation task and gives (id, value), as a model's wrapper does; its mean times
    100 is the metric COMET.
    """
    parts = []
    vectors = [c for c in VECTORS if c in predictions.columns]
    sources = [F.col("source")] if "source" in predictions.columns else []
    for task in tasks:
        lang = task.rpartition("_")[2]
        rows = predictions.where(F.col("task") == task).select(F.col("idx").cast("string").alias("id"), *sources, "prediction", "references", *vectors)
        found = [x for scorer in scorers(task) for x in scorer(rows, "en" if len(lang) != 2 else lang).items()]
        if comet is not None and "translation" in task:
            told = comet(rows.select("id", "source", "prediction", F.get("references", F.lit(0)).alias("reference")))
            found.append(("COMET", told.agg((F.avg("value") * 100).alias("value"))))
        for metric, value in found:
            parts.append(value.select(F.lit(task).alias("task"), F.lit(metric).alias("metric"), F.col("value").cast("double")))
    return reduce(lambda a, b: a.union(b), parts)


def accuracy_rows(pairs: DataFrame) -> DataFrame:
    """task, metric, value from the perplexities (task, correct, incorrect) of a right and a wrong candidate; ties are
    wrong, and so is what has no number."""
    value = F.avg(F.coalesce((F.col("correct") < F.col("incorrect")).cast("int"), F.lit(0))) * 100
    return pairs.groupBy("task").agg(value.alias("value")).select("task", F.lit("accuracy").alias("metric"), F.col("value").cast("double").alias("value"))


def reports(results: DataFrame) -> dict[str, list[str]]:
    """Header and value lines of each report table whose tasks are all there."""
    out = {}
    for title, prefix, keys, metrics, mean in REPORTS:
        table = T.selected(results, prefix, keys, metrics)
        if not table.isEmpty():
            out[title] = T.lines(T.means(table, metrics), [], metrics) if mean else T.lines(table, keys, metrics)
    return out
