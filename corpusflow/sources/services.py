"""External services behind small functions, with deterministic stand-ins that need no network."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Encoder = Callable[[list[str]], list[list[float]]]


def hashing_encoder(size: int = 64) -> Encoder:
    """Words hashed to signed coordinates, normalised. Equal texts have equal vectors."""

    def encode(texts: list[str]) -> list[list[float]]:
        import zlib

        out = np.zeros((len(texts), size))
        for i, text in enumerate(texts):
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % size] += 1 if h >> 31 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).tolist()

    return encode


def embed(chunks: DataFrame, encoder: Encoder | None = None, model: str = "hashing-64", text_col: str = "text") -> DataFrame:
    """Adds embedding and embedding_model; the encoder is called once per batch."""
    encode = encoder or hashing_encoder()

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(encode(texts.fillna("").tolist()))

    return chunks.withColumn("embedding", vectors(F.col(text_col))).withColumn("embedding_model", F.lit(model))


def complete(rows: DataFrame, prompt: Column, model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """Adds reply: what a language model says to the prompt; the stand-in repeats its last line."""
    ask = model or (lambda prompts: [p.strip().rsplit("\n", 1)[-1] for p in prompts])

    @F.pandas_udf("string")
    def replies(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series(ask(prompts.fillna("").tolist()))

    return rows.withColumn("reply", replies(prompt))


@F.pandas_udf(T.StringType())
def unescape_html(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else html.unescape(v))


def read_translation(payload: Column, source_lang: Column) -> Column:
    """struct<text, source> of a translation service's JSON answer: the first translation, unescaped."""
    first = F.get(F.from_json(payload, "data struct<translations:array<struct<translatedText:string,detectedSourceLanguage:string>>>")["data"]["translations"], F.lit(0))
    return F.struct(unescape_html(first["translatedText"]).alias("text"), F.coalesce(first["detectedSourceLanguage"], source_lang).alias("source"))


def read_geo(payload: Column) -> Column:
    """array<struct<id, place_name, address_name, x, y>> of a place search's JSON answer."""
    return F.from_json(
        payload, "documents array<struct<id:string,place_name:string,address_name:string,x:double,y:double>>"
    )["documents"]


def error_message(status: Column) -> Column:
    """What to tell a user when a model call fails with this HTTP status."""
    return F.when(status == 429, "rate_limited").when(status == 503, "overloaded").when(status == 404, "model_not_found").otherwise("unavailable")
