"""Model calls: a provider interface, retries, and the workers that call a provider batch by batch.

The default provider is offline and deterministic. A provider is made on the executors from a factory, so that clients and
their connections never travel.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import prompts
from ..functions import scalars as S


class Provider(Protocol):
    def complete(self, prompt: str, params: Params) -> str: ...

    def transcribe(self, path: str, params: Params) -> str: ...

    def look(self, path: str, prompt: str, params: Params) -> str: ...


@dataclass(frozen=True)
class Params:
    """FN-35: sampling parameters, and how a retry or the quality of an answer changes them."""

    temperature: float = 0.7
    top_p: float = 0.9
    max_tokens: int = 2000

    def after(self, retry: int) -> Params:
        scale, cap = {0: (1.0, 1.0), 1: (0.5, 0.9), 2: (1.5, 1.05)}.get(retry, (2.0, 1.1))
        return replace(self, temperature=min(self.temperature * scale, 2.0), top_p=min(self.top_p * cap, 0.99))

    def for_quality(self, score: float) -> Params:
        return self.after(1) if score < 0.5 else self


@dataclass(frozen=True)
class Retry:
    """UDF-12, FN-33: up to `retries` more calls; the pauses double from `base` up to `most` seconds; only retryable errors, if so set."""

    retries: int = 3
    base: float = 2.0
    most: float = 60.0
    smart: bool = True

    _WORDS = ("timeout", "connection", "network", "socket", "rate limit", "429", "500", "502", "503", "504")

    def delay(self, n: int) -> float:
        return min(self.base * 2**n, self.most)

    def worth(self, error: Exception) -> bool:
        text = str(error).lower()
        return not self.smart or any(w in text for w in self._WORDS)

    def __call__(self, call: Callable[[int], str], sleep: Callable[[float], None] = time.sleep) -> str:
        for n in range(self.retries + 1):
            try:
                return call(n)
            except Exception as error:
                if n == self.retries or not self.worth(error):
                    raise
                sleep(self.delay(n))
        raise AssertionError


class Offline:
    """Answers by rules: the drugs and capitalised words of a prompt's last line, as JSON in prose; media are told by their names."""

    def complete(self, prompt: str, params: Params) -> str:
        text = prompt.rpartition("\n")[2]
        drugs = [d for d in S.DRUGS if d in text.lower()]
        persons = [w for w in text.split() if w[:1].isupper() and w.isalpha()]
        return "Result: " + json.dumps({"drugs": drugs, "persons": persons, "category": "drug_box" if drugs else "other"}) + " end"

    def transcribe(self, path: str, params: Params) -> str:
        return _spoken(path)

    def look(self, path: str, prompt: str, params: Params) -> str:
        words = _spoken(path)
        if "extract" in prompt.lower():
            return words
        return "It shows a drug." if "drug" in words.lower() else "Nothing of note."


def _spoken(path: str) -> str:
    """The name of a file as words."""
    if not path:
        raise FileNotFoundError("File not found")
    return re.sub("[_-]+", " ", re.sub(r"\.[^.]*$", "", path.rpartition("/")[2]))


class Http:
    """UDF-1 to UDF-3: a JSON service at `url`; needs a network, and is imported only when used."""

    def __init__(self, url: str, key: str, timeout: float = 60.0) -> None:
        self.url, self.key, self.timeout = url, key, timeout

    def complete(self, prompt: str, params: Params) -> str:
        return self._sent(params, prompt=prompt)

    def transcribe(self, path: str, params: Params) -> str:
        return self._sent(params, audio=path)

    def look(self, path: str, prompt: str, params: Params) -> str:
        return self._sent(params, prompt=prompt, image=path)

    def _sent(self, params: Params, **what: str) -> str:
        from urllib.request import Request, urlopen

        body = json.dumps({**what, "temperature": params.temperature, "top_p": params.top_p, "max_tokens": params.max_tokens})
        request = Request(self.url, body.encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)["text"]


#: UDF-4: factories by name.
PROVIDERS: dict[str, Callable[..., Provider]] = {"offline": Offline, "http": Http}


def called(rows: DataFrame, key: str, text: str, instruction: str, make: Callable[[], Provider] = Offline, params: Params | None = None, retry: Retry | None = None, method: str = "complete") -> DataFrame:
    """UDF-5 to UDF-9, UDF-13: `key`, reply, error of every row: one call each, with retries; an error stays with its row."""
    return asked(rows, key, text, [instruction], make, params, retry, method).drop("n")


def asked(rows: DataFrame, key: str, text: str, questions: list[str], make: Callable[[], Provider] = Offline, params: Params | None = None, retry: Retry | None = None, method: str = "complete") -> DataFrame:
    """`key`, n, reply, error: every row with each of the questions, in one pass; `method` tells how the provider is called."""
    given, again = params or Params(), retry or Retry()

    def one(provider: Provider, question: str, t: str | None, n: int) -> str:
        if method == "complete":
            return provider.complete(f"{question}\n{t or ''}", given.after(n))
        return provider.look(t or "", question, given.after(n)) if method == "look" else provider.transcribe(t or "", given.after(n))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = make()
        for pdf in frames:
            out = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                for i, question in enumerate(questions):
                    try:
                        out.append((k, i, again(lambda n, t=t, q=question: one(provider, q, t, n)), None))
                    except Exception as error:
                        out.append((k, i, None, str(error)))
            yield pd.DataFrame(out, columns=["key", "n", "reply", "error"]).astype({"reply": "object", "error": "object"})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(work, f"key {kind}, n long, reply string, error string").withColumnRenamed("key", key)


def text_results(rows: DataFrame, key: str, text: str, make: Callable[[], Provider] = Offline) -> DataFrame:
    """UDF-5: drugs, entities (JSON text), validated, confidence of each text, from the JSON in the replies to two questions."""
    replies = asked(rows, key, text, [prompts("drugs")[0], prompts("entities")[0]], make)
    both = replies.groupBy(key).agg(F.max(F.when(F.col("n") == 0, S.salvaged_json(F.col("reply")))).alias("d"), F.max(F.when(F.col("n") == 1, S.salvaged_json(F.col("reply")))).alias("entities"), F.min("error").alias("error"))
    out = both.withColumn("p", F.from_json("d", "drugs array<string>")).withColumn("drugs", F.coalesce("p.drugs", F.array().cast("array<string>")))
    named = F.when(F.size("drugs") > 0, F.to_json(F.struct("drugs"))).otherwise("{}")
    valid = F.col("d").isNotNull() & S.validated(named, F.coalesce("entities", F.lit("{}")))
    return out.select(key, "drugs", "entities", valid.alias("validated"), F.round(S.text_confidence(F.size("drugs") > 0, F.col("entities").isNotNull(), valid), 6).alias("confidence"), "error")


def image_votes(rows: DataFrame, key: str, text: str, questions: list[str], make: Callable[[], Provider] = Offline) -> DataFrame:
    """UDF-8, AGG-6: category by the votes of several prompts."""
    from .metrics import majority

    votes = asked(rows, key, text, questions, make).withColumn("label", S.image_category(F.coalesce("reply", F.lit(""))))
    return majority(votes, key, "label", "n")


def differing(given: dict, wanted: dict) -> dict[str, tuple]:
    """UDF-7: parameters that aren't what is wanted: name to (given, wanted)."""
    return {k: (given.get(k), v) for k, v in wanted.items() if given.get(k) != v}
