"""One request at a time, as a service around the tables asks: limits, overrides, understanding, fallback; and embedding by a provider."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import questions
from . import search as S
from .analytics import overview

#: A provider takes texts and gives (place among them, vector) in any order.
Provider = Callable[[list[str]], list[tuple[int, list[float]]]]
MAX_MESSAGE, MAX_CHAT = 600, 20


@dataclass(frozen=True)
class Reply:
    rows: DataFrame
    filters: S.Filters
    mode: str
    facets: DataFrame | None = None
    #: Why the search went by words though there is a provider.
    warning: str | None = None


def _message(text: str) -> str:
    text = text.strip()
    if not 0 < len(text) <= MAX_MESSAGE:
        raise ValueError(f"a message has 1 to {MAX_MESSAGE} characters")
    return text


def understood(spark: SparkSession, message: str, thread: tuple[str, ...] = (), genero: str | None = None, canal: str | None = None) -> S.Filters:
    """The filters of a message after its thread; genero and canal that a request states go before those in its words."""
    turns = spark.createDataFrame([(0, i, t) for i, t in enumerate([*thread, message])], "thread int, turn int, text string")
    found = questions.thread_filters(turns, "thread", "turn").where(F.col("turn") == len(thread)).select(*questions.FIELDS).first()
    stated = {k: v for k, v in (("genero", genero), ("canal", canal)) if v}
    return replace(S.Filters(**found.asDict()), **stated)


def vector_or_reason(text: str, provider: Provider | None) -> tuple[list[float] | None, str | None]:
    """A text's vector, or none and why: without a provider, or when it fails, the search goes by words."""
    if provider is None:
        return None, None
    try:
        return [float(x) for x in dict(provider([text]))[0]], None
    except Exception as e:  # noqa: BLE001  whatever a provider raises, an answer is still due
        return None, f"no vector ({type(e).__name__}), searching by words"


def vector_of(text: str, provider: Provider | None) -> list[float] | None:
    """A text's vector; null without a provider or when it fails."""
    return vector_or_reason(text, provider)[0]


def search_request(products: DataFrame, stores: DataFrame, message: str, provider: Provider | None = None, limit: int = 12, offset: int = 0, genero: str | None = None, canal: str | None = None, fresh_hours: int | None = 12) -> Reply:
    text = _message(message)
    filters = replace(understood(products.sparkSession, text, (), genero, canal), fresh_hours=fresh_hours)
    vector, warning = vector_or_reason(text, provider)
    return Reply(S.search(products, stores, filters, vector, text.lower(), limit, offset), filters, "words" if vector is None else "meaning", warning=warning)


def chat_request(products: DataFrame, stores: DataFrame, message: str, thread: tuple[str, ...] = (), provider: Provider | None = None, limit: int = 12, genero: str | None = None, canal: str | None = None, fresh_hours: int | None = 12) -> Reply:
    """The message in its thread, with filters let go of until something is found, and refinements of what was found."""
    if not 0 < limit <= MAX_CHAT:
        raise ValueError(f"limit is 1 to {MAX_CHAT}")
    text, spark = _message(message), products.sparkSession
    filters = replace(understood(spark, text, thread, genero, canal), fresh_hours=fresh_hours)
    asked = spark.range(1).select(questions.query_text(F.lit(text), F.array(*map(F.lit, thread)).cast("array<string>")).alias("t")).first()["t"]
    vector, warning = vector_or_reason(asked, provider)
    rows = S.search_relaxed(products, stores, filters, vector, text.lower(), limit)
    used = tuple(a for a in ("tela", "detalle") if getattr(filters, a))
    return Reply(rows, filters, "words" if vector is None else "meaning", S.facets(rows, used), warning)


def health(products: DataFrame, variants: DataFrame, points: DataFrame, stores: DataFrame) -> DataFrame:
    """One row of totals, which a probe can ask for."""
    return overview(products, variants, points, stores)


def embedded(rows: DataFrame, text: str, provider: Provider, size: int = 64, column: str = "embedding") -> DataFrame:
    """rows with a vector for each text (null: as empty), asked for by tasks, `size` texts at a time and put back in order."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            vectors: list[list[float]] = []
            for at in range(0, len(texts), size):
                part = texts[at : at + size]
                answers = dict(provider(part))
                if sorted(answers) != list(range(len(part))):
                    raise ValueError("the provider has not answered for every text")
                vectors += [[float(x) for x in answers[i]] for i in range(len(part))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float64()))], [*b.schema.names, column])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(column, T.ArrayType(T.DoubleType()))]))
