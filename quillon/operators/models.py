"""The boundary to models: embedding providers, and a chat model with images behind retries, a limiter and degrading.

Nothing here needs a library: a provider is a function, and the stand-ins are deterministic. Model objects travel to the
executors, so what they hold must be picklable; limiters are per worker process."""

from __future__ import annotations

import base64
import mimetypes
import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import TOO_LARGE, TOO_MANY_IMAGES, TRANSIENT, hash_embedding

# Images in a request; what a text too large is cut to, and the length from which it isn't cut further.
MOST_IMAGES, SHRINK, SHORTEST = 3, 0.6, 800


class ModelError(RuntimeError):
    """What a model call failed with in the end; status is that of its provider, if it gave one."""

    def __init__(self, message: str, status: int | None = None, retry_after: str | None = None):
        super().__init__(message)
        self.status, self.retry_after = status, retry_after


def kind_of(error: BaseException) -> str:
    """image_limit, too_large, transient or fatal."""
    said, status = str(error), getattr(error, "status", None)
    if re.search(TOO_MANY_IMAGES, said, re.IGNORECASE):
        return "image_limit"
    if re.search(TOO_LARGE, said, re.IGNORECASE):
        return "too_large"
    if isinstance(error, (TimeoutError, ConnectionError)):
        return "transient"
    again = status == 429 or status >= 500 if isinstance(status, int) else re.search(TRANSIENT, said, re.IGNORECASE)
    return "transient" if again else "fatal"


def stated_wait(error: BaseException) -> float | None:
    """Seconds that a provider asks to wait: its header if that is a number, else its message."""
    try:
        return float(getattr(error, "retry_after", None))
    except (TypeError, ValueError):
        pass
    found = re.search(r"try again in\s+([0-9.]+)\s*(ms|s)\b", str(error), re.IGNORECASE)
    try:
        return float(found[1]) / (1000 if found[2].lower() == "ms" else 1) if found else None
    except ValueError:
        return None


@dataclass
class Limiter:
    """Calls are at least `gap` seconds apart, in this process. One lock-free slot: a worker process has one thread."""

    gap: float = 0.0
    free_at: float = 0.0

    def wait(self, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        if self.gap > 0:
            sleep(max(0.0, self.free_at - now()))
            self.free_at = now() + self.gap


def with_retries(call: Callable, retries: int = 4, most: float = 75.0, sleep: Callable[[float], None] = time.sleep):
    """Attempts until one succeeds, while errors are transient: waits the stated time and a second, else 2, 4, 8 ... , capped."""
    for n in range(retries + 1):
        try:
            return call()
        except Exception as error:
            if n == retries or kind_of(error) != "transient":
                raise
            wait = stated_wait(error)
            sleep(min(most, wait + 1 if wait is not None else 2.0 * 2**n))


def degrade(call: Callable[[str, list], str], text: str, images: list) -> str:
    """On too many images drop the last; on too large a request drop an image, else cut the text, down to SHORTEST."""
    while True:
        try:
            return call(text, images)
        except Exception as error:
            kind = kind_of(error)
            if images and kind in ("image_limit", "too_large"):
                images = images[:-1]
            elif kind == "too_large" and len(text) > SHORTEST:
                text = text[: int(len(text) * SHRINK)].rstrip() + "\n[cut]"
            else:
                raise


def flat(reply) -> str:
    """A reply as plain text: a string, a list of blocks, or an object with either as its content."""
    content = getattr(reply, "content", reply)
    if isinstance(content, (list, tuple)):
        content = "\n".join(b["text"] for b in content if isinstance(b, dict) and b.get("type") == "text" and b.get("text"))
    return str(content).strip()


def image_url(content: bytes, path: str) -> str:
    return f"data:{mimetypes.guess_type(path)[0] or 'image/png'};base64,{base64.b64encode(content).decode()}"


def first_block(text: str, images: Sequence[str] = (), system: str | None = None) -> str:
    """Stand-in for a chat model: the first block of what it is given, without the heading of sources."""
    return text.removeprefix("SOURCES\n").partition("\n\n")[0]


@dataclass
class ChatModel:
    """call(text, image URLs, system) -> reply, made robust. Errors leave as ModelError."""

    call: Callable = first_block
    retries: int = 4
    most_wait: float = 75.0
    gap: float = 0.0
    sleep: Callable[[float], None] = time.sleep
    limiter: Limiter = field(init=False)

    def __post_init__(self):
        self.limiter = Limiter(self.gap)

    def complete(self, text: str, images: Sequence[str] = (), system: str | None = None) -> str:
        def once(text: str, images: list) -> str:
            def attempt():
                self.limiter.wait(sleep=self.sleep)
                return flat(self.call(text, images, system))

            return with_retries(attempt, self.retries, self.most_wait, self.sleep)

        try:
            return degrade(once, text, list(images)[:MOST_IMAGES])
        except Exception as error:
            raise ModelError(str(error) or type(error).__name__, getattr(error, "status", None)) from error

    def check(self) -> None:
        """Raises ModelError if the model doesn't answer."""
        self.complete("Reply with the word ok.")


@dataclass(frozen=True)
class Embedder:
    """An embedding provider. embed(list of texts) -> list of vectors; without one, the stand-in made of hashes.

    Vectors are made unit-length here. Its fingerprint names the space they lie in."""

    provider: str = "sha256"
    model: str = "32"
    embed: Callable[[list[str]], list] | None = None
    batch: int = 128

    @property
    def fingerprint(self) -> str:
        return f"{self.provider}:{self.model}"

    def column(self, text: Column) -> Column:
        """array<double> of each text."""
        if self.embed is None:
            return hash_embedding(text, int(self.model))
        embed, size = self.embed, self.batch

        def run(texts: pd.Series) -> pd.Series:
            out, rows = [], texts.fillna("").tolist()
            for a in range(0, len(rows), size):
                out += [[float(x) for x in v] for v in embed(rows[a : a + size])]
            return pd.Series(out)

        raw = F.pandas_udf(run, "array<double>")(text)
        norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
        unit = lambda x: F.element_at(F.transform(F.array(norm(x)), lambda n: F.when(n > 0, F.transform(x, lambda v: v / n)).otherwise(x)), 1)
        return F.element_at(F.transform(F.array(raw), unit), 1)

    def dimension(self, spark) -> int:
        """Probes the provider; raises ModelError if it can't be used."""
        try:
            return len(spark.range(1).select(self.column(F.lit("probe")).alias("v")).first().v)
        except Exception as error:
            raise ModelError(f"the embedding provider can't be used: {str(error).splitlines()[0]}") from error
