"""What lies outside the engine, as objects that are handed in: fetching, embedding, language models. All have offline defaults."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Fetcher(Protocol):
    """(status, final URL, hops, body) of a URL; raises TimeoutError or OSError."""

    def __call__(self, url: str) -> tuple[int, str, int, str]: ...


class Pace:
    """How long a task waits before a request: longer after each 429, shorter after each success, as adapted_delay() has it."""

    def __init__(self, delay: float = 0.1, least: float = 0.05, most: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> None:
        self.delay, self.least, self.most, self.sleep = delay, least, most, sleep

    def wait(self) -> None:
        self.sleep(self.delay)

    def saw(self, status: int) -> None:
        if status == 429:
            self.delay = min(self.delay * 1.5, self.most)
        elif 200 <= status < 300:
            self.delay = max(self.delay * 0.95, self.least)


def fetch_pages(
    domains: DataFrame,
    fetcher: Fetcher,
    urls: Callable[[str], Iterable[str]] | None = None,
    partitions: int | None = None,
    accept: Callable[[int], bool] = lambda status: True,
    in_flight: int = 10,
    delay: float | None = 0.1,
) -> DataFrame:
    """(domain, asked, redirect_url, status_code, error, html) for each distinct domain: https, then plain http, or the given ladder.

    The first answer whose status `accept` takes ends the ladder; if none does, the row has the last answer's status, the error "Status"
    and no page. What fails is a "Timeout", a "Request" (any OSError) or "Other". A task keeps in_flight domains under way at a
    time, each asked once, and waits `delay` seconds before a request, which adapts to 429s and successes (None: never waits).
    What is done is handed on 64 rows at a time; the order is that of completion, see restore_order()."""
    ladder = urls or (lambda d: (f"https://{d}", f"http://{d}"))
    rows = domains.select(F.trim("domain").alias("domain")).where(F.col("domain") != "").distinct()
    rows = rows.repartition(partitions, "domain") if partitions else rows
    names = ["domain", "asked", "redirect_url", "status_code", "error", "html"]

    def one(d: str, pace: Pace | None) -> tuple:
        row = (d, None, None, None, "no URL", None)
        for url in ladder(d):
            if pace:
                pace.wait()
            try:
                status, final, hops, body = fetcher(url)
            except TimeoutError:
                row = (d, url, None, None, "Timeout", None)
            except OSError:
                row = (d, url, None, None, "Request", None)
            except Exception:  # a fetcher's own errors end one request, not the task
                row = (d, url, None, None, "Other", None)
            else:
                if pace:
                    pace.saw(status)
                redirect = final if hops and final != url else None
                if accept(status):
                    return d, url, redirect, status, None, body[:1_000_000]
                row = (d, url, redirect, status, "Status", None)
        return row

    def run(batches):
        pace = None if delay is None else Pace(delay)
        frame = lambda out: pd.DataFrame(out, columns=names).astype({"status_code": "Int32"})
        with ThreadPoolExecutor(in_flight) as pool:
            waiting, done = set(), []
            for d in (d for x in batches for d in x["domain"]):
                waiting.add(pool.submit(one, d, pace))
                if len(waiting) >= 2 * in_flight:
                    ready, waiting = wait(waiting, return_when=FIRST_COMPLETED)
                    done += [f.result() for f in ready]
                if len(done) >= 64:
                    yield frame(done)
                    done = []
            yield frame(done + [f.result() for f in waiting])

    return rows.mapInPandas(run, "domain string, asked string, redirect_url string, status_code int, error string, html string")


def load_models(chains: dict[str, list[Callable[[], object]]]) -> dict[str, object]:
    """The first of each name's loaders that works; names without one are left out, and none at all is an error."""
    found, why = {}, []
    for name, loaders in chains.items():
        for load in loaders:
            try:
                found[name] = load()
                break
            except Exception as e:  # any loader's own errors
                why.append(f"{name}: {e}")
    if not found:
        raise RuntimeError("no model could be loaded: " + "; ".join(why))
    return found


def hashed_embedding(dim: int = 64, seed: int = 0) -> Callable[[Column], Column]:
    """The offline embedder: words hashed to signed places, normalized to length one. A model's encoder takes its place in production."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> np.ndarray:
            v = np.zeros(dim, np.float32)
            for w in (t or "").lower().split():
                h = xxhash.xxh64_intdigest(w, seed)
                v[h % dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            return v / n if n else v

        return texts.map(one)

    return embed


def ask_with_retry(client: Callable[[str], str], prompt: str, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The client's answer; waits 5, 10, 20 ... seconds after an error that names a quota or rate, else one; None after the last try."""
    for k in range(tries):
        try:
            return client(prompt)
        except Exception as e:  # any client's own errors
            if k < tries - 1:
                sleep(5 * 2**k if "quota" in str(e).lower() or "rate" in str(e).lower() else 1)
    return None


def ask_labels(df: DataFrame, prompt: Column, client: Callable[[str], str], tries: int = 3) -> DataFrame:
    """df with the column response."""

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: None if p is None else ask_with_retry(client, p, tries))

    return df.withColumn("response", ask(prompt))
