"""Sequences for models: suffix encoding, masks and labels, padding, length-sorted batches, step arithmetic, pluggable inference."""

from __future__ import annotations

import math
import threading
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import numbered

#: Labels that the loss ignores.
IGNORED = -100


@dataclass(frozen=True)
class SpecialIds:
    pad: int = 0
    bos: int = 64000
    eos: int = 64001
    language: int = 64006

    @staticmethod
    def of(vocabulary: dict[str, int], unknown: int | None = None) -> SpecialIds:
        """The ids of the markers; a marker that the vocabulary lacks is an error."""
        names = {"pad": "<pad>", "bos": "<s>", "eos": "</s>", "language": "<2hi>"}
        missing = [t for t in names.values() if vocabulary.get(t, unknown) == unknown]
        if missing:
            raise ValueError(f"vocabulary lacks {', '.join(missing)}")
        return SpecialIds(**{k: vocabulary[t] for k, t in names.items()})


@dataclass(frozen=True)
class GenerationSettings:
    max_source_length: int = 512
    max_target_length: int = 80
    num_beams: int = 4
    no_repeat_ngram_size: int = 3
    length_penalty: float = 1.0
    early_stopping: bool = True

    def pinned(self, special: SpecialIds) -> dict:
        """The settings with the ids that generation must use: it starts with the language mark and is made to end."""
        return {**asdict(self), "pad_token_id": special.pad, "bos_token_id": special.bos, "eos_token_id": special.eos, "decoder_start_token_id": special.language, "forced_eos_token_id": special.eos}


#: Settings of the comparison run with another published model.
COMPARISON = GenerationSettings(max_target_length=84, no_repeat_ngram_size=2)


class BatchSummarizer(Protocol):
    def summarize(self, texts: list[str], batch_size: int = 8) -> list[str]: ...


def encode(ids: Column | str, special: SpecialIds, max_length: int) -> Column:
    """The ids cut to leave room, then end mark and language mark."""
    return F.concat(F.slice(ids, 1, max(max_length - 2, 0)) if max_length > 2 else F.array().cast("array<int>"), F.array(F.lit(special.eos), F.lit(special.language)))


def hashed_ids(text: Column | str, buckets: int = 50_000) -> Column:
    """Stand-in ids of white-space words (100 plus their length, below 100 plus buckets), for tests and data preparation without a vocabulary."""
    return F.transform(T.whitespace_words(text), lambda w: (F.length(w) % buckets + 100).cast("int"))


def preprocess(df: DataFrame, special: SpecialIds, source: str, target: str, max_source: int, max_target: int) -> DataFrame:
    """input_ids, attention_mask and labels from id arrays; other columns are dropped except the row's key columns."""
    out = df.withColumn("input_ids", encode(source, special, max_source)).withColumn("labels", encode(target, special, max_target))
    return out.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))).drop(source, target)


def padded(df: DataFrame, batch: str, column: str, pad: int) -> DataFrame:
    """Lists of a batch filled on the right to its longest; the longest is a map-side aggregate, no list is gathered."""
    longest = df.groupBy(batch).agg(F.max(F.size(column)).alias("_longest"))
    out = df.join(longest, batch)
    return out.withColumn(column, F.concat(column, F.array_repeat(F.lit(pad), F.col("_longest") - F.size(column)))).drop("_longest")


def unmask(labels: Column | str, pad: int) -> Column:
    """Ignored labels as pads."""
    return F.transform(labels, lambda x: F.when(x == IGNORED, F.lit(pad)).otherwise(x))


def batches(df: DataFrame, length: str, batch_size: int = 8, order: str = "pos", by: str = "split") -> DataFrame:
    """chunk: consecutive blocks of 8 batches by order; place, batch: longest first inside a chunk, equal lengths in order."""
    out = numbered(df, by, order, "_at").withColumn("chunk", F.floor(F.col("_at") / (batch_size * 8))).drop("_at")
    place = F.row_number().over(Window.partitionBy(by, "chunk").orderBy(F.desc(length), order)) - 1
    return out.withColumn("place", place).withColumn("batch", F.floor(F.col("place") / batch_size))


def training_steps(examples: int, batch_size: int, accumulation: int, epochs: float, eval_steps: int, warmup_ratio: float) -> dict[str, int]:
    per_epoch = math.ceil(examples / (batch_size * accumulation))
    total = math.ceil(per_epoch * epochs)
    return {"per_epoch": per_epoch, "total": total, "eval_steps": min(eval_steps, total), "warmup": int(total * warmup_ratio)}


def pick_device(requested: str | None, available: tuple[str, ...] = ()) -> str:
    """What was asked for, or else the best that is there. Across executors Spark's resource scheduling decides."""
    return requested or next((d for d in ("cuda", "mps") if d in available), "cpu")


def generation_metrics(df: DataFrame, decode: Callable[[Column], Column], pad: int, predicted: str = "predicted", labels: str = "labels") -> DataFrame:
    """One row of mean rouge1, rouge2, rougeL and gen_words of generated ids against label ids; ignored ids are pads on both sides.
    decode makes a text of an id array (a Column function of the caller's tokenizer)."""
    from .metrics import scored

    texts = df.select(T.clean_output(decode(unmask(predicted, pad))).alias("prediction"), T.clean_output(decode(unmask(labels, pad))).alias("reference"))
    scores = scored(texts).withColumn("gen_words", F.size(T.whitespace_words("prediction")))
    return scores.agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("rouge1", "rouge2", "rougeL", "gen_words")))


def fine_tune(train: Callable, processes: int, *arguments, gpu: bool = False):
    """Runs a training function of the caller's on the cluster's processes; needs torch."""
    try:
        from pyspark.ml.torch.distributor import TorchDistributor
    except ImportError as error:
        raise RuntimeError("training needs torch") from error
    return TorchDistributor(num_processes=processes, local_mode=False, use_gpu=gpu).run(train, *arguments)


def parameter_counts(model) -> dict[str, int]:
    """Trainable and all parameters of a model whose ``parameters()`` have ``numel()`` and ``requires_grad``."""
    sizes = [(p.numel(), p.requires_grad) for p in model.parameters()]
    return {"trainable": sum(n for n, trained in sizes if trained), "total": sum(n for n, _ in sizes)}


def configure_generation(model, special: SpecialIds, settings: GenerationSettings | None = None):
    """Pins the ids of generation on the model's own configuration and on that of generation, where it has them, and gives the model back."""
    pinned = (settings or GenerationSettings()).pinned(special)
    for holder in (getattr(model, "config", None), getattr(model, "generation_config", None)):
        if holder is not None:
            for name in ("pad_token_id", "bos_token_id", "eos_token_id", "decoder_start_token_id", "forced_eos_token_id"):
                setattr(holder, name, pinned[name])
    return model


def imported(name: str) -> Callable[[], BatchSummarizer]:
    """The factory that ``module:attribute`` names; how command lines name a model."""
    from importlib import import_module

    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError("a model is named as module:attribute")
    return getattr(import_module(module), attribute)


class ModelRegistry:
    """A model for each name, made on first use, once a process."""

    _models: dict[str, BatchSummarizer] = {}
    _lock = threading.Lock()

    @classmethod
    def get(cls, name: str, make: Callable[[], BatchSummarizer] | None) -> BatchSummarizer:
        if make is None:
            raise RuntimeError("no model is configured")
        if name not in cls._models:
            with cls._lock:
                if name not in cls._models:
                    cls._models[name] = make()
        return cls._models[name]

    @classmethod
    def loaded(cls, name: str) -> bool:
        return name in cls._models


class FirstWords:
    """A deterministic stand-in model: the first words of a text, between marker tokens."""

    def __init__(self, words: int = 8) -> None:
        self.words = words

    def summarize(self, texts: list[str], batch_size: int = 8) -> list[str]:
        return [f"<2hi> {' '.join(t.split()[: self.words])} </s>" for t in texts]


def summarize(df: DataFrame, make: Callable[[], BatchSummarizer], name: str = "model", text: str = "text", batch_size: int = 8) -> DataFrame:
    """df with ``summary`` of a pluggable model: clean, longest first inside each Arrow batch to save padding, generate, strip markers.
    The model is loaded once a worker; rows keep their columns, and no row leaves its partition."""
    prepared = df.withColumn("_clean", T.clean_text(text))

    def run(batches_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = ModelRegistry.get(name, make)
        for batch in batches_:
            texts = batch["_clean"].tolist()
            order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
            got = model.summarize([texts[i] for i in order], batch_size)
            back = dict(zip(order, got, strict=True))
            yield batch.assign(summary=[back[i] for i in range(len(texts))])

    kept = [f for f in prepared.schema.fields if f.name != "summary"]
    prepared = prepared.select(*(f.name for f in kept))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", summary string"
    return prepared.mapInPandas(run, schema).drop("_clean").withColumn("summary", T.clean_output("summary"))
