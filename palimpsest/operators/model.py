"""The boundary to a language model: prompts, calls, replies."""

from __future__ import annotations

import json
import random
import re
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from palimpsest.functions.text import normal_text

#: Takes a prompt, gives the reply; called in the workers.
Client = Callable[[str], str]
REPLACEMENT = "struct<original:string,placeholder:string,category:string,confidence:double,reason:string>"


#: The reply that finds nothing.
NOTHING = '{"replacements": []}'


def silent(prompt: str) -> str:
    """The default client: finds nothing, so results are deterministic."""
    return NOTHING


class RateLimited(Exception):
    """What a client raises when its service asks it to slow down."""


#: Parts of a message by which a failure counts as a matter of rate. Fixed values.
RATE_MARKS = ("rate_limit", "429", "quota")


def request_tokens(prompt: str, most: int = 8192) -> int:
    """What a request may cost: words times 1.3 and the reply's bound, rounded down."""
    return int(len(prompt.split()) * 1.3 + most)


@dataclass
class Limiter:
    """At most so many requests and tokens in a window. Threads of a process share one; ``lanes`` makes it one for each process.

    A request holds what it may cost from the moment it is let go, and what it has cost once that is recorded.
    """

    requests: int = 450
    tokens: int = 81_000
    seconds: float = 60.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __post_init__(self):
        self._past: deque[list] = deque()
        self._met: set = set()
        self._lock = threading.Lock()

    def __getstate__(self) -> dict:
        # What a limiter has seen belongs to its process.
        return {k: v for k, v in self.__dict__.items() if k not in ("_past", "_met", "_lock")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def share(self, lanes: int) -> Limiter:
        """A limiter with one lane's part of the allowance."""
        return Limiter(max(1, self.requests // lanes), max(1, self.tokens // lanes), self.seconds, self.clock, self.sleep, self.name)

    def remember(self, calls: dict[object, tuple[float, int]]) -> None:
        """Counts calls made elsewhere, each once, by a name: how many seconds ago and what it cost."""
        with self._lock:
            now = self.clock()
            self._past.extend([now - ago, tokens] for name, (ago, tokens) in calls.items() if name not in self._met)
            self._met = set(calls)
            self._past = deque(sorted(self._past, key=lambda h: h[0]))

    def spend(self) -> None:
        """Counts the whole allowance as used just now."""
        self._past.extend([self.clock(), 0] for _ in range(self.requests))

    def wait(self, tokens: int) -> list:
        """Returns, with what stands for it, when a request of so many tokens fits; one above the whole allowance goes when nothing else is in the window."""
        while True:
            with self._lock:
                now = self.clock()
                while self._past and self._past[0][0] <= now - self.seconds:
                    self._past.popleft()
                if not self._past or (len(self._past) < self.requests and sum(n for _, n in self._past) + tokens < self.tokens):
                    held = [now, tokens]
                    self._past.append(held)
                    return held
                rest = self._past[0][0] + self.seconds - now
            self.sleep(rest)

    def record(self, tokens: int, held: list | None = None) -> None:
        """What a request, the last one if none is named, has cost."""
        with self._lock:
            if held is None and self._past:
                held = self._past[-1]
            if held is not None:
                held[1] = tokens


@dataclass
class Retrying:
    """A client that keeps to a limit, waits a random moment before each call and tries again where the rate or the connection failed.

    Waits double from ``least`` to ``longest`` seconds. Any other failure is raised at once.
    """

    client: Client
    attempts: int = 5
    least: float = 2.0
    longest: float = 60.0
    jitter: tuple[float, float] = (0.2, 0.6)
    most_tokens: int = 8192
    limiter: Limiter = field(default_factory=Limiter)
    sleep: Callable[[float], None] = time.sleep

    def with_limiter(self, limiter: Limiter) -> Retrying:
        return replace(self, limiter=limiter)

    def __call__(self, prompt: str) -> str:
        for attempt in range(self.attempts):
            held = self.limiter.wait(request_tokens(prompt, self.most_tokens))
            self.sleep(random.uniform(*self.jitter))
            try:
                reply = self.client(prompt)
            except Exception as e:  # noqa: BLE001 - sorted out below
                again = isinstance(e, (RateLimited, ConnectionError)) or any(m in str(e).lower() for m in RATE_MARKS)
                self.limiter.record(len(prompt.split()), held)
                if not again or attempt + 1 == self.attempts:
                    raise
                self.sleep(min(self.longest, max(self.least, 2.0**attempt)))
                continue
            self.limiter.record(len(reply.split()) + len(prompt.split()), held)
            return reply
        raise RateLimited("no attempt was allowed")


def prompt_for_chunk(template: str, text: Column) -> Column:
    """The template with doubled braces single and {text_chunk} filled in."""
    return F.replace(F.lit(_plain(template)), F.lit("\x00"), text)


def _plain(template: str) -> str:
    return template.replace("{text_chunk}", "\x00").replace("{{", "{").replace("}}", "}")


def chunk_caller(template: str, client: Client) -> Callable[[list[str]], list[list]]:
    """``prompt_for_chunk`` and ``called`` for texts that lie in a worker."""
    plain = _plain(template)
    return lambda texts: called(client, [None if t is None else plain.replace("\x00", t) for t in texts])


def prompt_for_context(template: str, fields: dict[str, Column], source: Column, most: int = 15_000) -> Column:
    out = F.lit(template)
    for name, value in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return F.replace(out, F.lit("{source_text}"), F.substring(source, 1, most))


def _added(rows: DataFrame, names: tuple[str, ...], compute: Callable[[list], list[list]], source: str) -> DataFrame:
    """Rows with string columns added that Python computes from one column; columns of those names are replaced."""
    rest = rows.drop(*names) if source not in names else rows.select(*[c for c in rows.columns if c not in names or c == source])
    columns = rest.columns
    at = columns.index(source)
    kept = [k for k, c in enumerate(columns) if c not in names]
    schema = StructType([*[rest.schema.fields[k] for k in kept], *[StructField(n, StringType()) for n in names]])

    def run(batches):
        for b in batches:
            made = compute(b.column(at).to_pylist())
            yield pa.record_batch([*[b.column(k) for k in kept], *[pa.array(x, pa.string()) for x in made]], names=[*[columns[k] for k in kept], *names])

    return rest.mapInArrow(run, schema)


def called(client: Client, prompts: list) -> list[list]:
    """Replies and errors of prompts; a failing call is an error of its prompt, a null prompt is no call."""
    replies, errors = [], []
    for p in prompts:
        if p is None:
            replies.append(None)
            errors.append(None)
            continue
        try:
            replies.append(client(p))
            errors.append(None)
        except Exception as e:  # noqa: BLE001 - any failure belongs to its row
            replies.append(None)
            errors.append(str(e))
    return [replies, errors]


def ask(prompts: DataFrame, client: Client = silent) -> DataFrame:
    """Adds ``reply`` and ``error``, as ``called`` gives them, to rows with a ``prompt``. Columns of these names are replaced."""
    return _added(prompts, ("reply", "error"), lambda given: called(client, given), "prompt")


def reply_json(reply: Column) -> Column:
    """The JSON part of a reply: inside the first fence, if any, from the first brace on."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(F.contains(reply, F.lit("```")) & (fenced != ""), fenced).otherwise(reply)
    return F.when(F.startswith(body, F.lit("{")), body).otherwise(F.regexp_extract(body, r"(?s)(\{.*)", 1))


def _closed(json: Column) -> Column:
    """A reply's JSON part up to its last brace, parsed; null if it is none."""
    return F.try_parse_json(F.when(F.endswith(json, F.lit("}")), json).otherwise(F.regexp_extract(json, r"(?s)(\{.*\})", 1)))


def _replacements(json: Column, closed: Column) -> Column:
    found = F.from_json(json, f"struct<replacements:array<{REPLACEMENT}>>")
    return F.when(json == "", None).when(closed.isNull() & found["replacements"].isNull(), None).otherwise(F.coalesce(found["replacements"], F.array().cast(f"array<{REPLACEMENT}>")))


def replacements_in(reply: Column) -> Column:
    """The reply's list of replacements; empty if it has none, null if it is no JSON object."""
    return _replacements(reply_json(reply), _closed(reply_json(reply)))


def _spoilt(closed: Column, text: Column) -> Column:
    items = F.try_variant_get(closed, "$.replacements", "array<variant>")

    def bad(item: Column) -> Column:
        original = F.coalesce(F.try_variant_get(item, "$.original", "string"), F.lit(""))
        null = F.coalesce(F.is_variant_null(F.try_variant_get(item, "$.placeholder", "variant")), F.lit(False))
        return ~F.startswith(F.schema_of_variant(item), F.lit("OBJECT")) | ((original != "") & F.contains(text, original) & null)

    return F.coalesce(F.exists(items, bad), F.lit(False))


def spoilt_reply(reply: Column, text: Column) -> Column:
    """Whether a reply's list holds an item that is no object, or one whose original stands in the text but whose placeholder is null."""
    return _spoilt(_closed(reply_json(reply)), text)


def good_replacements(answers: DataFrame, name: str) -> DataFrame:
    """Adds to rows (text, reply, error, …) the ``replacements_in`` the reply; null too where the call has failed, the reply is an error or it is spoilt.

    The JSON part and its parsed form are columns on the way, so they are made once for each reply; ``NOTHING`` is known without them.
    """
    nothing = F.coalesce(F.col("error").isNull() & (F.col("reply") == NOTHING), F.lit(False))
    rows = answers.withColumn("_json", F.when(~nothing, reply_json(F.col("reply"))))
    rows = rows.withColumn("_closed", _closed(F.col("_json")))
    json, closed = F.col("_json"), F.col("_closed")
    whole = F.when(F.endswith(json, F.lit("}")), closed).otherwise(F.try_parse_json(json))
    is_error = F.coalesce(F.try_variant_get(whole, "$.error", "variant").isNotNull(), F.lit(False))
    good = F.col("error").isNull() & ~is_error & ~_spoilt(closed, F.col("text"))
    return rows.withColumn(name, F.when(nothing, F.array().cast(f"array<{REPLACEMENT}>")).when(good, _replacements(json, closed))).drop("_json", "_closed")


# The key of an extraction reply, and what ends its text where the reply is broken.
_KEY = "extracted_content"
_ENDS = ('", "reasoning"', '","reasoning"', '"}')
_KEYED = re.compile(rf'"{_KEY}"\s*:\s*"((?:[^"\\]|\\.)*)"', re.DOTALL)
_OPENED = re.compile(rf'"{_KEY}"[^:]*:[^"]*"')
_ESCAPES = (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"))


def extracted_content(reply: str | None) -> str | None:
    """The content of an extraction reply: as JSON, else by its key, else from the key on to one of ``_ENDS``; None if there is none.

    A reply in a fence is no JSON, so of its forms only an object is understood, by its key.
    """
    if not reply:
        return None
    try:
        found = json.loads(reply)
    except ValueError:
        found = 0
    if isinstance(found, list):
        if found and isinstance(found[0], str):
            return "\n\n".join(found) if all(isinstance(x, str) for x in found) else None
        if not (found and isinstance(found[0], dict)):
            return str(found)
        found = found[0]
    if isinstance(found, dict):
        x = found.get(_KEY)
        return x if isinstance(x, str) and x else None
    if m := _KEYED.search(reply):
        text = m[1]
        for written, meant in _ESCAPES:
            text = text.replace(written, meant)
        return text or None
    if not (m := _OPENED.search(reply)):
        return None
    cut = min((k for end in _ENDS if (k := reply.find(end, m.end())) >= 0), default=-1)
    return reply[m.end() : cut].replace('\\"', '"') or None if cut >= 0 else None


def contents(replies: DataFrame) -> DataFrame:
    """Adds ``content``, normalised, to rows with a ``reply``; a column of that name is replaced."""
    return _added(replies, ("content",), lambda given: [[extracted_content(r) for r in given]], "reply").withColumn("content", normal_text(F.col("content")))


def resolve_parsed(parsed: Column) -> Column:
    """The text of a parsed document given as JSON: markdown, else the document's own texts or elements, else text, else ''."""
    v = F.try_parse_json(parsed)
    get = lambda path: F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))

    def joined(path: str) -> Column:
        rows = F.from_json(F.try_variant_get(v, path, "string"), "array<struct<content:string>>")
        return F.nullif(F.array_join(F.filter(F.transform(rows, lambda r: r["content"]), lambda c: c.isNotNull()), "\n\n"), F.lit(""))

    document = F.when(F.schema_of_variant(F.try_variant_get(v, "$.document", "variant")) == "STRING", get("$.document"))
    return F.coalesce(get("$.markdown"), get("$.document.markdown"), get("$.document.content"), get("$.document.text"), joined("$.document.elements"), joined("$.document.chunks"), document, get("$.text"), F.lit(""))
