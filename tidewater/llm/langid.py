"""Language identification with one Kneser-Ney character model for each language.

Interpolated Kneser-Ney models of order 5 over lower-cased letters are counted over all documents
that name their language. A text gets the language with the lowest cross-entropy a symbol. Documents
of the table itself are scored by models of the folds they are not in, so none is known by its own
letters. Rejection is calibrated on those scores, over all documents that name the language they get:
a text of n symbols is rejected if its cross-entropy lies more than `deviations` standard errors above
their median, where the error allows for the spread between documents (1.4826 x median absolute
deviation, at least the share `spread` of the median) besides variance / n. A language with too few
texts to split (`heldout.scarce`) is counted over all folds, and mean and `spread` of its model stand
in for the calibration, as they do for texts outside the table; its rejection is lenient.

Defined results: null, empty and letterless texts get no language and are rejected; documents with a
null language are classified but not learned from; of equal cross-entropies the language first in
alphabetical order wins; if no document names a language all are rejected; repeated rows are each
classified; an empty table gives no rows; other columns are left as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.heldout import folds, scarce
from tidewater.llm.kneser_ney import BITS, ORDER, KneserNey, counted, groups_of
from tidewater.llm.naming import fresh
from tidewater.llm.perplexity import bands
from tidewater.llm.textscan import let_go
from tidewater.operators.lineage import keep

DEVIATIONS, SPREAD = 4.0, 0.12
MODEL_BYTES = 1 << 30
SCORE_BYTES = 1 << 19


def fit_groups(docs: DataFrame, order: int = ORDER, model_bytes: int = MODEL_BYTES) -> Iterator[KneserNey]:
    """The models of all languages in docs(lang, text), in groups of at most `model_bytes`.

    What the driver gets is the table of distinct 5-grams of letters of one group at a time, which the languages
    bound, not the number of documents; their number is known before any of them is fetched.
    """
    with counted(docs, "letters", order) as (counts, sizes):
        groups = groups_of(sizes, model_bytes, joint=True)
        alphabet = counts.select(F.col("code").bitwiseAND(F.lit((1 << BITS) - 1))).distinct().count() if len(groups) > 1 else None
        for group in groups:
            table = counts.where(F.col("lang").isin(group)).toArrow()
            names = table["lang"].combine_chunks().dictionary_encode()
            index = np.searchsorted(group, names.dictionary.to_pylist())[names.indices.to_numpy()]
            yield KneserNey(group, index, table["code"].to_numpy().view(np.uint64), table["n"].to_numpy(), order, alphabet=alphabet)


def fit(docs: DataFrame, order: int = ORDER) -> KneserNey | None:
    """One model of all languages in docs(lang, text); None if there is none."""
    models = list(fit_groups(docs, order))
    if len(models) > 1:
        raise ValueError(f"models of {len(models)} groups of languages; classify takes one")
    return models[0] if models else None


def classify(spark: SparkSession, model: KneserNey | Broadcast | None, deviations: float = DEVIATIONS, spread: float = SPREAD):
    """A function of a text column: struct(lang, cross_entropy, symbols, mean, variance, accepted).

    mean and variance are those of a symbol under the language's model, by which `accepted` is decided.
    """
    names = ("lang", "cross_entropy", "symbols", "mean", "variance", "accepted")
    kinds = (pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
    fields = [pa.field(n, k) for n, k in zip(names, kinds, strict=True)]
    shared = model if isinstance(model, Broadcast) else spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,cross_entropy:double,symbols:long,mean:double,variance:double,accepted:boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            if model is None:
                n = len(texts)
                null = pa.nulls(n, pa.float64())
                yield pa.StructArray.from_arrays([pa.nulls(n, pa.string()), null, pa.array(np.zeros(n, np.int64)), null, null, pa.array(np.zeros(n, bool))], fields=fields)
                continue
            entropy, sizes = model.cross_entropy(texts, "letters", SCORE_BYTES)
            best = entropy.argmin(axis=1)
            value = entropy[np.arange(len(best)), best]
            mean, variance = model.mean[best], model.variance[best]
            accepted = (sizes > 0) & (value <= mean + deviations * np.sqrt(variance / np.maximum(sizes, 1) + (spread * mean) ** 2))
            none = sizes == 0
            lang = pa.array(np.array(model.langs, dtype=object)[best], pa.string(), mask=none)
            yield pa.StructArray.from_arrays([lang, *(pa.array(x, mask=m) for x, m in ((value, none), (sizes, None), (mean, none), (variance, none))), pa.array(accepted)], fields=fields)
        del model
        let_go(shared)

    return run


class _Judge:
    """Models for the folds of docs, each row's by models that never saw its text, and what they say of rows."""

    def __init__(self, docs: DataFrame, deviations: float, spread: float, model_bytes: int):
        self.spark, self.deviations, self.spread = docs.sparkSession, deviations, spread
        docs = docs.select("lang", "text")
        self.few = scarce(docs)
        self.models = [[self.spark.sparkContext.broadcast(m) for m in fit_groups(learn, model_bytes=model_bytes)] for learn, _ in folds(docs, self.few)]
        self.limits: dict[str, tuple[float, float]] = {}

    def of(self, docs: DataFrame, columns: list[Column], given: str, name: str) -> DataFrame:
        """columns of docs, the language given and a struct as of classify for every row.

        Where the models come in groups, each group's pass is kept before the next, so that no worker holds
        two; of equal cross-entropies the language first in alphabetical order stays.
        """
        body, other = fresh([*docs.columns, given, name], "text_scored", "identified_too")
        out = None
        for models, (_, rows) in zip(self.models, folds(docs, self.few), strict=True):
            part = rows.select(*columns, F.col("lang").alias(given), F.col("text").alias(body))
            for i, model in enumerate(models or [None]):
                says = classify(self.spark, model, self.deviations, self.spread)(body)
                if not i:
                    part = part.withColumn(name, says)
                    continue
                part = keep(part).withColumn(other, says)
                closer = F.coalesce(F.col(f"{other}.cross_entropy") < F.col(f"{name}.cross_entropy"), F.lit(False))
                part = part.withColumn(name, F.when(closer, F.col(other)).otherwise(F.col(name))).drop(other)
            part = part.drop(body)
            out = part if out is None else out.unionAll(part)
        return out

    def calibrate(self, scored: DataFrame, given: str, name: str) -> None:
        """Middle and spread of nats a symbol, from all rows that get the language they name."""
        own = scored.where(F.col(given) == F.col(f"{name}.lang")).where(~F.col(given).isin(self.few))
        self.limits = bands(own.select(F.col(given).alias("lang"), F.col(f"{name}.cross_entropy").alias("nats"), F.col(f"{name}.symbols").alias("symbols")), self.spread)

    def accepts(self, name: str) -> Column:
        s = F.col(name)
        middle, wide = s.mean, F.lit(self.spread) * s.mean
        for lang, (m, w) in self.limits.items():
            middle, wide = F.when(s.lang == lang, F.lit(m)).otherwise(middle), F.when(s.lang == lang, F.lit(w)).otherwise(wide)
        error = F.sqrt(s.variance / F.greatest(s.symbols, F.lit(1)) + wide * wide)
        return F.coalesce((s.symbols > 0) & (s.cross_entropy <= middle + F.lit(self.deviations) * error), F.lit(False))


def identify(docs: DataFrame, deviations: float = DEVIATIONS, spread: float = SPREAD, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """(doc_id, lang, cross_entropy, symbols, accepted) of every document."""
    judge = _Judge(docs, deviations, spread, model_bytes)
    scored = keep(judge.of(docs.select("doc_id", "lang", "text"), [F.col("doc_id")], "given", "s"))
    judge.calibrate(scored, "given", "s")
    return scored.select("doc_id", "s.lang", "s.cross_entropy", "s.symbols", judge.accepts("s").alias("accepted"))


def keep_identified(docs: DataFrame, deviations: float = DEVIATIONS, spread: float = SPREAD, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """docs without the documents that identification rejects; columns and values as they were, whatever their names.

    Documents are scored twice, for the calibration and for the decision, rather than kept with their texts.
    """
    given, name = fresh(docs.columns, "language_given", "identified")
    judge = _Judge(docs, deviations, spread, model_bytes)
    judge.calibrate(judge.of(docs.select("lang", "text"), [], given, name), given, name)
    scored = judge.of(docs, [F.col(f"`{c}`") for c in docs.columns], given, name)
    return scored.where(judge.accepts(name)).drop(given, name)
