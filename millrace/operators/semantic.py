"""Model-backed functions behind an injected provider: distinct inputs are called once, in batches.

A provider takes a list of prompts and returns a list of strings; it must be picklable and is given to the
workers. StubProvider is deterministic and offline; its output says nothing of any model's quality. Operators
and pipelines of steps become SQL functions by register_*.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cosine_to
from . import shared

Provider = Callable[[list[str]], list[str]]


class StubProvider:
    """Answers with a word that the prompt's digest picks."""

    def __init__(self, answers: tuple[str, ...] = ("yes", "no")) -> None:
        self.answers = answers

    def __call__(self, prompts: list[str]) -> list[str]:
        return [self.answers[hashlib.sha256(p.encode()).digest()[0] % len(self.answers)] for p in prompts]


def stub_embedding(text: str, size: int = 128) -> list[float]:
    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")
    x = np.random.default_rng(seed).uniform(-1, 1, size)
    return (x / np.linalg.norm(x)).tolist()


def render(template: str, inputs: dict, steps: dict | None = None) -> str:
    """{{ x }} or {{ inputs.x }}, and {{ steps.n.output }}; dots go down into JSON."""

    def put(m: re.Match) -> str:
        value: object = {**inputs, "inputs": inputs, "steps": steps or {}}
        for part in m[1].split("."):
            if isinstance(value, str):
                try:
                    value = json.loads(value)
                except ValueError:
                    return ""
            value = value.get(part, "") if isinstance(value, dict) else value[int(part)] if isinstance(value, list) and part.isdigit() and int(part) < len(value) else ""
        return value if isinstance(value, str) else json.dumps(value)

    return re.sub(r"\{\{\s*([\w.]+)\s*\}\}", put, template)


def vote(answers: list[str]) -> str:
    """The most frequent trimmed answer, of equal ones the earliest."""
    counts = Counter(a.strip() for a in answers)
    return max(counts, key=lambda a: (counts[a], -[x.strip() for x in answers].index(a)))


def consensus(lists: list[list[dict]]) -> list[dict]:
    """Items named in a majority of lists, with their mean confidence."""
    seen: dict[str, list[float]] = {}
    for items in lists:
        for name, c in {i["name"]: float(i.get("confidence", 1.0)) for i in items}.items():
            seen.setdefault(name, []).append(c)
    return [{"name": n, "confidence": sum(c) / len(c)} for n, c in seen.items() if len(c) >= len(lists) // 2 + 1]


@dataclass
class Operator:
    """A prompt template with takes, retries and wards. A validator's None or error passes.

    takes (1 to 12) are reduced by vote, first_valid, consensus (JSON lists of items) or evaluator, a provider that
    is given the numbered answers and names one. A retry's prompt is the feedback template, if there is one, over
    prompt and output.
    """

    name: str
    template: str
    takes: int = 1
    attempts: int = 1
    valid: Callable[[str], bool | None] | None = None
    before: list[tuple[Callable[[str], bool | None], bool]] = field(default_factory=list)
    after: list[tuple[Callable[[str], bool | None], bool]] = field(default_factory=list)
    reduce: str = "vote"
    feedback: str | None = None
    evaluator: Provider | None = None

    @staticmethod
    def passes(check: Callable[[str], bool | None] | None, text: str) -> bool:
        try:
            return check is None or check(text) is not False
        except Exception:  # a broken validator passes, by definition
            return True

    def identity(self, provider: Provider) -> str:
        """What answers depend on besides the inputs."""
        return "\x1f".join([self.name, self.template, getattr(provider, "model", type(provider).__name__), str(self.takes), str(self.attempts), self.reduce, self.feedback or ""])

    def answer(self, provider: Provider, text: str) -> str | None:
        return self.answers(provider, [{"text": text}])[0]

    def answers(self, provider: Provider, inputs: list[dict]) -> list[str | None]:
        """One for each input: a call of the provider for each take and attempt, with all prompts that are left."""
        open_ = [i for i, x in enumerate(inputs) if all(self.passes(w, str(x.get("text", ""))) for w, blocking in self.before if blocking)]
        prompts = {i: render(self.template, inputs[i]) for i in open_}
        takes: dict[int, list[str]] = {i: [] for i in open_}
        for take in range(min(max(self.takes, 1), 12)):
            left = {i: f"{prompts[i]}\n#{take}.0" if take else prompts[i] for i in open_}
            got: dict[int, str] = {}
            for attempt in range(1, max(self.attempts, 1) + 1):
                if not left:
                    break
                for i, out in zip(left, provider(list(left.values()))):
                    got[i] = out
                again = {i: f"{prompts[i]}\n#{take}.{attempt}" for i in left if not self.passes(self.valid, got[i])}
                left = {i: render(self.feedback, {**inputs[i], "prompt": prompts[i], "output": got[i]}) if self.feedback else p for i, p in again.items()}
            for i in open_:
                takes[i].append(got[i])
        out: list[str | None] = [None] * len(inputs)
        for i in open_:
            best = self.reduced(takes[i])
            out[i] = best if all(self.passes(w, best) for w, blocking in self.after if blocking) else None
        return out

    def reduced(self, takes: list[str]) -> str:
        if self.reduce == "first_valid":
            return next((t for t in takes if self.passes(self.valid, t)), takes[0])
        if self.reduce == "consensus":
            return json.dumps(consensus([json.loads(t) for t in takes]))
        if self.reduce == "evaluator":
            listed = "\n".join(f"{n}. {t}" for n, t in enumerate(takes, 1))
            m = re.search(r"\d+", self.evaluator([listed])[0])
            return takes[int(m[0]) - 1] if m and 1 <= int(m[0]) <= len(takes) else takes[0]
        return vote(takes)


@dataclass
class Steps:
    """Named steps (name, kind, body), each seeing the inputs and the outputs before it; the last is the answer.

    Kinds: llm (a template for the provider), specialist (a name of providers and a template), code (a name of
    CODE), python (a function of inputs and outputs), sql (a SELECT over :names, run in memory), and tool (a name of
    tools and a template of JSON arguments), which stands for remote tools, workflows and agents.
    """

    name: str
    steps: list[tuple[str, str, object]]
    providers: dict[str, Provider] = field(default_factory=dict)
    tools: dict[str, Callable[[dict], object]] = field(default_factory=dict)

    def identity(self, provider: Provider) -> str:
        return "\x1f".join([self.name, repr([(n, k, b if isinstance(b, (str, tuple)) else getattr(b, "__name__", "")) for n, k, b in self.steps]), getattr(provider, "model", type(provider).__name__)])

    def answers(self, provider: Provider, inputs: list[dict]) -> list[str | None]:
        outputs: list[dict] = [{} for _ in inputs]
        for name, kind, body in self.steps:
            if kind == "llm":
                got = provider([render(body, x, o) for x, o in zip(inputs, outputs)])
            elif kind == "specialist":
                got = self.providers[body[0]]([render(body[1], x, o) for x, o in zip(inputs, outputs)])
            else:
                got = [self._one(kind, body, x, o) for x, o in zip(inputs, outputs)]
            for o, g in zip(outputs, got):
                o[name] = {"output": g}
        return [o[self.steps[-1][0]]["output"] for o in outputs]

    def _one(self, kind: str, body, inputs: dict, outputs: dict) -> str | None:
        last = list(outputs.values())[-1]["output"] if outputs else str(inputs.get("text", ""))
        if kind == "code":
            return CODE[body](last)
        if kind == "python":
            return body(inputs, {n: o["output"] for n, o in outputs.items()})
        if kind == "sql":
            import sqlite3

            con = sqlite3.connect(":memory:")
            con.execute("PRAGMA query_only = ON")
            row = con.execute(body, {**inputs, **{n: o["output"] for n, o in outputs.items()}}).fetchone()
            return None if row is None or row[0] is None else str(row[0])
        if kind == "tool":
            out = self.tools[body[0]](json.loads(render(body[1], inputs, outputs)))
            return out if isinstance(out, str) else json.dumps(out)
        raise ValueError(f"no step kind {kind}")


#: Steps of kind code: functions of the output before.
CODE: dict[str, Callable[[str], str]] = {
    "strip": str.strip,
    "upper": str.upper,
    "lower": str.lower,
    "first_line": lambda s: next((x.strip() for x in s.split("\n") if x.strip()), ""),
    "digits": lambda s: "".join(c for c in s if c.isdigit()),
    "json_keys": lambda s: json.dumps(sorted(json.loads(s))),
}


def apply(table: DataFrame, column: str, operator: Operator | Steps, provider: Provider, output: str, cache: DataFrame | None = None, arguments: dict[str, str] | None = None) -> DataFrame:
    """table with output: each distinct text that the cache (key, answer) lacks is asked once, then joined back."""
    answers = answered(table, column, operator, provider, cache, arguments).select(F.col("text").alias(column), F.col("answer").alias(output))
    return table.join(answers, column, "left").select(*table.columns, output)


def answered(table: DataFrame, column: str, operator: Operator | Steps, provider: Provider, cache: DataFrame | None = None, arguments: dict[str, str] | None = None) -> DataFrame:
    """(text, key, answer) of the distinct texts: what a cache keeps. The key is of all that an answer depends on."""
    texts = table.select(F.col(column).alias("text")).filter("text is not null").distinct()
    fixed = operator.identity(provider) + "\x1f" + json.dumps(arguments or {}, sort_keys=True)
    texts = texts.withColumn("key", F.sha2(F.concat_ws("\x1f", F.lit(fixed), F.col("text")), 256))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"text": b.text, "key": b.key, "answer": operator.answers(provider, [{"text": t, **(arguments or {})} for t in b.text])})

    schema = "text string, key string, answer string"
    if cache is None:
        return texts.mapInPandas(ask, schema)
    known = texts.join(cache.select("key", "answer"), "key").select("text", "key", "answer")
    return known.unionByName(texts.join(cache.select("key"), "key", "left_anti").select("text", "key").mapInPandas(ask, schema))


def receipts(table: DataFrame, column: str, operator: Operator, provider: Provider, rate: float, arguments: dict[str, str] | None = None) -> DataFrame:
    """operator, calls, characters and cost of asking for all distinct texts, without asking: what explain shows.

    rate is for a thousand characters of prompts; a call with takes costs as many prompts.
    """
    texts = table.select(F.col(column).alias("text")).filter("text is not null").distinct()
    fixed = len(render(operator.template, {"text": "", **(arguments or {})}))
    takes = min(max(operator.takes, 1), 12)
    out = texts.agg((F.count("*") * takes).alias("calls"), (F.coalesce(F.sum(F.length("text") + fixed), F.lit(0)) * takes).alias("characters"))
    return out.select(F.lit(operator.name).alias("operator"), "calls", "characters", (F.col("characters") / 1000.0 * rate).alias("cost"))


def self_tests(spark, tests: list[tuple[str, str, str, object]]) -> DataFrame:
    """(name, passed) of tests (name, SQL of one value, exact | min | max | regex, what is expected)."""
    judge = {
        "exact": lambda got, want: got == want,
        "min": lambda got, want: got is not None and got >= want,
        "max": lambda got, want: got is not None and got <= want,
        "regex": lambda got, want: got is not None and re.search(want, str(got)) is not None,
    }
    rows = []
    for name, sql, how, want in tests:
        try:
            rows.append((name, bool(judge[how](spark.sql(sql).first()[0], want))))
        except Exception:  # a test that can't run has failed
            rows.append((name, False))
    return spark.createDataFrame(rows, "name string, passed boolean")


# --- Operators that come with the engine, and operators as SQL functions ------------------------------

#: Name, arguments, type, and a template each.
SEEDED: dict[str, tuple[tuple[str, ...], str, str]] = {
    "means": (("text", "criterion"), "boolean", "Does the text meet the criterion? Answer YES or NO.\nCriterion: {{ criterion }}\nText: {{ text }}"),
    "about": (("text", "topic"), "double", "From 0 to 1, how much is the text about the topic? Answer with the number.\nTopic: {{ topic }}\nText: {{ text }}"),
    "contradicts": (("text", "other"), "boolean", "Does the first statement contradict the second? Answer YES or NO.\n1: {{ text }}\n2: {{ other }}"),
    "supports": (("text", "other"), "boolean", "Does the first statement support the second? Answer YES or NO.\n1: {{ text }}\n2: {{ other }}"),
    "implies": (("text", "other"), "boolean", "Does the first statement imply the second? Answer YES or NO.\n1: {{ text }}\n2: {{ other }}"),
    "summarize": (("text",), "string", "Sum the text up in a few sentences.\nText: {{ text }}"),
    "condense": (("text",), "string", "Say what the text says in three sentences or fewer.\nText: {{ text }}"),
    "headline": (("text",), "string", "Write a headline for the text.\nText: {{ text }}"),
    "classify": (("text", "categories"), "string", "Which of the categories fits the text? Answer with its name alone.\nCategories: {{ categories }}\nText: {{ text }}"),
    "safe_classify": (("text", "categories"), "string", "Which of the categories fits the text? Answer with its name alone.\nCategories: {{ categories }}\nText: {{ text }}"),
    "extract": (("text", "what"), "string", "Copy from the text: {{ what }}. Answer with that alone.\nText: {{ text }}"),
    "sentiment": (("text",), "string", "Is the text positive, negative, neutral or mixed? Answer with one word.\nText: {{ text }}"),
    "clean_year": (("text",), "string", "Which year of four digits does the text name? Answer with it alone.\nText: {{ text }}"),
    "redact": (("text",), "string", "Repeat the text with every name and number replaced by [X].\nText: {{ text }}"),
    "themes": (("text",), "array<string>", "List the themes of the text, parted by commas.\nText: {{ text }}"),
    "tags": (("text",), "array<string>", "List tags for the text, parted by commas.\nText: {{ text }}"),
    "aspects": (("text",), "array<string>", "List the aspects that the text judges, parted by commas.\nText: {{ text }}"),
    "entities": (("text",), "array<string>", "List the names in the text, parted by commas.\nText: {{ text }}"),
    "keyphrases": (("text",), "array<string>", "List the key phrases of the text, parted by commas.\nText: {{ text }}"),
}


def seeded(name: str, **options) -> Operator:
    """An operator of the engine; clean_year retries, headline takes three, redact lets no digit out."""
    own: dict = {}
    if name == "clean_year":
        own = {"attempts": 3, "valid": lambda s: re.fullmatch(r"\s*[12]\d{3}\s*", s) is not None}
    elif name == "headline":
        own = {"takes": 3}
    elif name == "redact":
        own = {"after": [(lambda s: not re.search(r"\d", s), True)]}
    return Operator(name, SEEDED[name][2], **(own | options))


def parsed(text: str | None, kind: str):
    """An answer as a value of a SQL type: the rules of yes_no, score_0_1 and label lists."""
    if text is None:
        return None
    if kind == "boolean":
        return re.match(r"YES|TRUE|1", text.lstrip().upper()) is not None
    if kind == "double":
        m = re.search(r"-?[0-9]+(?:\.[0-9]+)?", text)
        return min(max(float(m[0]), 0.0), 1.0) if m else None
    if kind == "array<string>":
        try:
            items = [str(x) for x in json.loads(text)]
        except (ValueError, TypeError):
            items = re.split(r"[,;\n]", text)
        return list(dict.fromkeys(x.strip() for x in items if x.strip()))
    return text.strip()


def register_scalar(spark, name: str, operator: Operator | Steps, provider: Provider, arguments: tuple[str, ...] = ("text",), kind: str = "string") -> None:
    """name(arguments) in SQL: in each batch, distinct inputs are asked once; a null input gives null."""

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        rows = list(zip(*columns))
        own = list(dict.fromkeys(r for r in rows if all(x is not None and x == x for x in r)))
        known = dict(zip(own, operator.answers(provider, [dict(zip(arguments, r)) for r in own])))
        return pd.Series([parsed(known.get(r), kind) for r in rows], dtype=object)

    spark.udf.register(name, run)


def register_seeded(spark, provider: Provider, prefix: str = "") -> list[str]:
    for name, (arguments, kind, _) in SEEDED.items():
        register_scalar(spark, prefix + name, seeded(name), provider, arguments, kind)
    return [prefix + n for n in SEEDED]


def register_rows(spark, name: str, operator: Operator | Steps, provider: Provider) -> None:
    """name(text) in SQL as a table function: a row (label, place) for each label of the answer."""

    class Labels:
        def eval(self, text: str):
            if text is not None:
                for i, label in enumerate(parsed(operator.answers(provider, [{"text": text}])[0], "array<string>") or []):
                    yield label, i

    spark.udtf.register(name, F.udtf(Labels, returnType="label string, place int"))


def register_aggregate(spark, name: str, operator: Operator | Steps, provider: Provider) -> None:
    """name(text) in SQL as an aggregate: one answer for the sorted distinct texts of a group that a task can hold.

    For groups of any size there is aggregate().
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> str:
        own = sorted(set(texts.dropna()))
        return operator.answers(provider, [{"text": json.dumps(own, ensure_ascii=False, separators=(",", ":"))}])[0] if own else None

    spark.udf.register(name, run)


_RUNNER = """
import json, sys
space = {}
exec(json.loads(sys.stdin.readline()), space)
entry = space[json.loads(sys.stdin.readline())]
for line in sys.stdin:
    try:
        out = {"value": entry(*json.loads(line))}
    except Exception as e:
        out = {"error": type(e).__name__ + ": " + str(e)}
    print(json.dumps(out), flush=True)
"""


def register_handler(spark, name: str, source: str, entry: str, kind: str = "string", python: str | None = None) -> None:
    """A user's Python function as name(...) in SQL, run by an interpreter of its own (python: that of another environment).

    It sees neither the worker's modules nor its settings; an error in it fails the query.
    """

    @F.pandas_udf(kind)
    def run(*columns: pd.Series) -> pd.Series:
        import subprocess
        import sys

        rows = [[x.item() if hasattr(x, "item") else x for x in r] for r in zip(*columns)]
        head = [json.dumps(source), json.dumps(entry)]
        text = "\n".join(head + [json.dumps(r) for r in rows]) + "\n"
        done = subprocess.run([python or sys.executable, "-I", "-c", _RUNNER], input=text, capture_output=True, text=True, env={}, check=True)
        out = [json.loads(line) for line in done.stdout.splitlines()]
        bad = next((o["error"] for o in out if "error" in o), None)
        if bad or len(out) != len(rows):
            raise RuntimeError(bad or done.stderr[-500:])
        return pd.Series([o["value"] for o in out], dtype=object)

    spark.udf.register(name, run)


def dimension(table: DataFrame, column: str, output: str) -> DataFrame:
    """One row for each label of a separated list: a JSON array, or parts between commas, semicolons and lines."""
    x = F.col(column)
    parts = F.coalesce(F.from_json(x, "array<string>"), F.split(x, r"[,;\n]"))
    labels = F.array_distinct(F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != ""))
    return table.withColumn(output, F.explode(labels))


def aggregate(table: DataFrame, key: str, column: str, operator: Operator, provider: Provider, limit: int = 1000) -> DataFrame:
    """(key, answer): one for each key from all its distinct texts.

    A call takes limit texts at most. A key with more is dealt to as many parts as it needs, and the parts' answers
    are asked about in turn, until one is left. No task holds a whole key.
    """
    left = table.select(key, F.col(column).alias("_text")).filter("_text is not null").distinct()
    while True:
        parts = left.groupBy(key).agg(F.ceil(F.count("*") / limit).alias("_parts"))
        dealt = left.join(parts, key).withColumn("_part", F.pmod(F.xxhash64("_text"), F.col("_parts")))
        state = dealt.groupBy(key, "_part").agg(F.to_json(F.sort_array(F.collect_list("_text"))).alias("_state"))
        left = shared.cut(apply(state, "_state", operator, provider, "answer").select(key, F.col("_part").cast("string").alias("_part"), "answer"))
        if left.groupBy(key).count().filter("count > 1").isEmpty():
            return left.select(key, "answer")
        left = left.filter("answer is not null").select(key, F.concat_ws(": ", "_part", "answer").alias("_text"))


def embed_batch(texts: list[str], size: int = 128) -> list[list[float]]:
    return [stub_embedding(t, size) for t in texts]


def embed(table: DataFrame, column: str, embedder: Callable[[str], list[float]] = stub_embedding) -> DataFrame:
    """(text, v) of the distinct texts of a column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"text": b.text, "v": [embedder(t) for t in b.text]})

    return table.select(F.col(column).alias("text")).filter("text is not null").distinct().mapInPandas(run, "text string, v array<double>")


def semantic_case(vectors: DataFrame, conditions: list[list[float]], results: list[str], default: str, least: float) -> DataFrame:
    """vectors (id, v) with the result of the nearest condition, the first of equal ones, if near enough."""
    if len(conditions) != len(results):
        raise ValueError("as many results as conditions are needed")
    near = F.array(*[F.struct(cosine_to(F.col("v"), c).alias("s"), F.lit(-i).alias("i")) for i, c in enumerate(conditions)])
    best = F.array_max(near)
    named = F.element_at(F.array(*[F.lit(r) for r in results]), 1 - best["i"])
    return vectors.select("id", F.when(best["s"] >= least, named).otherwise(default).alias("result"))
