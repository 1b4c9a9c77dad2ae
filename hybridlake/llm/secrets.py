"""Secret scans by grammar inference (operator 6).

Three fixed patterns find the base spans, which also serve as the labelled
credentials. For each kind a prefix tree counts the credentials' shapes; states
whose outcomes are statistically compatible are merged (red-blue state merging
with Hoeffding bounds) into a probabilistic automaton. A background automaton
is learnt alike from all long tokens that are no credentials. Every candidate
token among them is scored by the likelihood of its shape; one that a
credential automaton explains, and explains better than the background does, is
a span of kind ``format``.

Shapes are counted in Spark, over every token of every text and in their whole
length. The states are merged on the driver from the shapes that make up
``min_share`` of the tokens at least, and so at most 1 / ``min_share`` of a
kind whatever the corpus holds. All other shapes then run through these states
in Spark, and every one counts in the automaton's arcs, ends and likelihoods:
of them only sums by state and symbol reach the driver.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hybridlake.llm.common import in_batches, keyed, stored, texts

KINDS = ("assign", "access", "hex", "format")
_ORDER = {kind: i for i, kind in enumerate(KINDS)}

#: Fixed patterns. Matches are maximal, so a least length inside the pattern
#: finds what a test after the match would keep.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_CHARS = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Every access and hex match lies within such a token.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{16,}")
#: What tells a token from a long word.
MIXED = re.compile(r"[0-9]|[a-z][A-Z]")

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                     T.StructField("end", T.LongType()), T.StructField("value", T.StringType())])


@dataclass(frozen=True)
class SecretParams:
    #: Share of the distinct credentials of a kind, or of all other tokens, that a shape makes up at least to have a say
    #: in which states there are; rarer ones count in what these states do.
    min_share: float = 1e-4
    #: Confidence of the Hoeffding test of two states.
    alpha: float = 0.05
    #: Log-likelihood by which a format must beat the background.
    margin: float = 1.0
    #: Share of a kind's credentials that may be less likely, a symbol, than an accepted token.
    quantile: float = 0.01


WORD = re.compile(r"[A-Za-z0-9]+")


def _kind_of(word: str) -> str:
    """What letters and digits a word is made of, as one symbol."""
    digits = any(c.isdigit() for c in word)
    lower, upper = word != word.upper(), word != word.lower()
    if lower and upper:
        return "b" if digits else "m"
    if upper:
        return "N" if digits else "U"
    if not lower:
        return "d"
    return "l" if not digits else "n" if word.strip("0123456789abcdef") else "x"


def shape(token: str) -> str:
    """Every letter and digit becomes the kind of its word, so that a format's random characters look alike; the rest stays."""
    return WORD.sub(lambda m: _kind_of(m.group()) * len(m.group()), token)


@dataclass
class Automaton:
    """``arcs[state][symbol]`` = (next state, probability); ``stop[state]`` = probability of an end."""

    arcs: list[dict[str, tuple[int, float]]] = field(default_factory=list)
    stop: list[float] = field(default_factory=list)
    #: Likelihood of a symbol that a state has never seen, and of an unseen end.
    unseen: float = 1e-6

    def log_likelihood(self, symbols: str) -> float:
        state, total = 0, 0.0
        for symbol in symbols:
            following = self.arcs[state].get(symbol) if state is not None else None
            state, p = following or (None, self.unseen)
            total += math.log(p)
        return total + math.log(max(self.unseen, self.stop[state] if state is not None else 0.0))


@dataclass
class Tally:
    """What went through each state: ``used[state][symbol]`` = [next state, count]; ``ends[state]`` = count."""

    used: list[dict[str, list[int]]] = field(default_factory=lambda: [{}])
    ends: list[int] = field(default_factory=lambda: [0])

    def automaton(self) -> Automaton:
        seen = [sum(n for _, n in arcs.values()) + end for arcs, end in zip(self.used, self.ends)]
        return Automaton([{c: (t, n / max(1, m)) for c, (t, n) in arcs.items()} for arcs, m in zip(self.used, seen)],
                         [end / max(1, m) for end, m in zip(self.ends, seen)])

    def targets(self) -> dict[str, int]:
        """Where each symbol leads most often: its arc from states that have none of their own."""
        flow: dict[str, dict[int, int]] = {}
        for arcs in self.used:
            for symbol, (to, n) in arcs.items():
                flow.setdefault(symbol, {})[to] = flow.get(symbol, {}).get(to, 0) + n
        return {symbol: max(to, key=lambda t: (to[t], -t)) for symbol, to in flow.items()}

    def walk(self, sample: str, targets: Mapping[str, int]) -> Iterator[tuple[int, str | None]]:
        """(state, symbol) of each step, and (state, None) at the end; a symbol that leads nowhere stays in its state."""
        state = 0
        for symbol in sample:
            yield state, symbol
            own = self.used[state].get(symbol)
            state = own[0] if own else targets.get(symbol, state)
        yield state, None

    def with_steps(self, steps: Mapping[tuple[int, str | None], int]) -> Tally:
        """This tally and counted steps of ``walk``."""
        targets = self.targets()
        used, ends = [{c: list(arc) for c, arc in arcs.items()} for arcs in self.used], list(self.ends)
        for (state, symbol), n in sorted(steps.items(), key=str):
            if symbol is None:
                ends[state] += n
            else:
                used[state].setdefault(symbol, [targets.get(symbol, state), 0])[1] += n
        return Tally(used, ends)


def learn(samples: Mapping[str, int], alpha: float = SecretParams.alpha) -> Automaton:
    return tally(samples, alpha).automaton()


def tally(samples: Mapping[str, int], alpha: float = SecretParams.alpha) -> Tally:
    """State merging over the prefix tree of samples and their counts: the most frequent
    unmerged state joins the first compatible red state, or turns red itself."""
    seen, ends, arcs, used = [0], [0], [{}], [{}]
    for sample, n in samples.items():
        state = 0
        seen[0] += n
        for symbol in sample:
            if symbol not in arcs[state]:
                arcs[state][symbol] = len(seen)
                seen.append(0)
                ends.append(0)
                arcs.append({})
                used.append({})
            used[state][symbol] = used[state].get(symbol, 0) + n
            state = arcs[state][symbol]
            seen[state] += n
        ends[state] += n
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(a: int, b: int, in_a: int, in_b: int) -> bool:
        return abs(in_a / seen[a] - in_b / seen[b]) > bound * (1 / math.sqrt(seen[a]) + 1 / math.sqrt(seen[b]))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if differ(a, b, ends[a], ends[b]):
                return False
            for symbol in used[a].keys() | used[b].keys():
                if differ(a, b, used[a].get(symbol, 0), used[b].get(symbol, 0)):
                    return False
            todo += [(arcs[a][s], arcs[b][s]) for s in arcs[a].keys() & arcs[b].keys()]
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            seen[a] += seen[b]
            ends[a] += ends[b]
            for symbol, n in used[b].items():
                used[a][symbol] = used[a].get(symbol, 0) + n
                if symbol in arcs[a]:
                    todo.append((arcs[a][symbol], arcs[b][symbol]))
                else:
                    arcs[a][symbol] = arcs[b][symbol]

    red = [0]
    while seen[0]:
        is_red = set(red)
        blue = {arcs[s][c]: (s, c) for s in red for c in arcs[s] if arcs[s][c] not in is_red}
        if not blue:
            break
        state = max(blue, key=lambda s: (seen[s], -s))
        like = next((r for r in red if compatible(r, state)), None)
        if like is None:
            red.append(state)
        else:
            parent, symbol = blue[state]
            arcs[parent][symbol] = like
            fold(like, state)
    name = {s: i for i, s in enumerate(red)}
    if not seen[0]:
        return Tally()
    return Tally([{c: [name[arcs[s][c]], n] for c, n in used[s].items()} for s in red], [ends[s] for s in red])


@dataclass
class Formats:
    """The automata, the least likelihood a symbol that each accepts, and the background."""

    params: SecretParams
    automata: dict[str, Automaton]
    least: dict[str, float]
    background: Automaton

    def accepts(self, token: str) -> bool:
        symbols = shape(token)
        against = self.background.log_likelihood(symbols) + self.params.margin
        for kind, automaton in self.automata.items():
            found = automaton.log_likelihood(symbols)
            if found > against and found / (len(symbols) + 1) >= self.least[kind]:
                return True
        return False


Span = tuple[str, int, int, str]


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans by (start, kind), and the long tokens beside them; places are code points."""
    found: list[Span] = []
    tokens: list[Span] = []
    for token in TOKEN.finditer(text):
        at, value = token.start(), token.group()
        found += [("access", at + m.start(), at + m.end(), m.group()) for m in ACCESS.finditer(value)]
        found += [("hex", at + m.start(), at + m.end(), m.group()) for m in HEX.finditer(value)]
        tokens.append(("format", at, token.end(), value))
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text)
                  if len(m.group(2)) >= ASSIGN_CHARS]
    found.sort(key=lambda s: (s[1], _ORDER[s[0]]))
    return found, apart(tokens, found)


def apart(spans: list[Span], found: list[Span]) -> list[Span]:
    """The spans that overlap none of ``found``, which come by start."""
    starts, ends = [s[1] for s in found], list(accumulate((s[2] for s in found), max))
    before = ((s, bisect_left(starts, s[2])) for s in spans)  # those that start before a span's end
    return [s for s, n in before if not n or ends[n - 1] <= s[1]]


def candidates(tokens: list[Span]) -> list[Span]:
    """The tokens that are no plain words."""
    return [t for t in tokens if MIXED.search(t[3])]


def all_spans(base: list[Span], others: list[Span], formats: Formats) -> list[Span]:
    added = [c for c in others if formats.accepts(c[3])]
    return sorted([*base, *added], key=lambda s: (s[1], _ORDER[s[0]]))


def scan_base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, candidates, shapes`` of every row: the spans, and the shapes of all tokens beside base spans."""
    source = keyed(docs, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType),
                           T.StructField("base", T.ArrayType(SPAN)), T.StructField("candidates", T.ArrayType(SPAN)),
                           T.StructField("shapes", T.ArrayType(T.StringType()))])
    arrow = to_arrow_schema(schema)
    names = SPAN.names

    def rows(batch: pa.RecordBatch):
        for doc, text in zip(batch.column(0).to_pylist(), texts(batch)):
            base, tokens = base_spans(text)
            yield doc, *([dict(zip(names, s)) for s in spans] for spans in (base, candidates(tokens))), [shape(t[3]) for t in tokens]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from in_batches(rows(batch), arrow)

    return source.mapInArrow(run, schema)


def learn_shapes(shapes: DataFrame, name: str, params: SecretParams) -> tuple[Automaton, float] | None:
    """The automaton of ``shapes(shape, n)``, every one counted, and the likelihood of a symbol at their
    ``quantile``; None without shapes.

    The states come from the shapes that make up ``min_share`` of all; the rest
    adds its steps through them.
    """
    counted = stored(shapes.groupBy("shape").agg(F.sum("n").alias("n")), name)
    total = counted.agg(F.sum("n")).first()[0] or 0
    if not total:
        return None
    common = F.col("n") >= params.min_share * total
    known = {r["shape"]: r["n"] for r in counted.where(common).collect()}
    learnt = tally(known, params.alpha)
    rest = total - sum(known.values())
    if rest:
        learnt = learnt.with_steps(steps_of(counted.where(~common), learnt))
    automaton, rank = learnt.automaton(), params.quantile * total
    if rest:
        return automaton, quantile_of(stored(likelihoods(counted, automaton), f"{name}-likelihoods"), rank)
    at = 0
    for value, n in sorted((automaton.log_likelihood(s) / (len(s) + 1), n) for s, n in known.items()):
        at += n
        if at > rank:
            break
    return automaton, value


def steps_of(counted: DataFrame, learnt: Tally) -> dict[tuple[int, str | None], int]:
    """How often the shapes of ``counted(shape, n)`` take each step through the states: a row for a state and symbol."""
    targets = learnt.targets()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps: dict[tuple[int, str | None], int] = {}
        for batch in batches:
            for sample, n in zip(batch["shape"], batch["n"]):
                for step in learnt.walk(sample, targets):
                    steps[step] = steps.get(step, 0) + int(n)
        yield pd.DataFrame([(*step, n) for step, n in steps.items()], columns=["state", "symbol", "n"]).astype(
            {"state": "int32", "symbol": "object", "n": "int64"})

    found = counted.mapInPandas(run, "state int, symbol string, n long").groupBy("state", "symbol").agg(F.sum("n").alias("n"))
    return {(r["state"], r["symbol"]): r["n"] for r in found.collect()}


def likelihoods(counted: DataFrame, automaton: Automaton) -> DataFrame:
    """``value, n``: the likelihood of a symbol of each shape."""
    each = F.pandas_udf(lambda shapes: shapes.map(lambda s: automaton.log_likelihood(s) / (len(s) + 1)), T.DoubleType())
    return counted.select(each("shape").alias("value"), "n")


def quantile_of(values: DataFrame, rank: float, bins: int = 1000) -> float:
    """The least of ``values(value, n)`` up to which more than ``rank`` are counted, exactly: bins are narrowed to it."""
    below = 0
    low, high = values.agg(F.min("value"), F.max("value")).first()
    while low < high:
        place = F.least(F.lit(bins - 1), F.floor((F.col("value") - low) / F.lit((high - low) / bins)))
        held = values.where(F.col("value").between(low, high)).groupBy(place.alias("bin")).agg(
            F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).orderBy("bin").collect()
        for r in held:
            if below + r["n"] > rank or r is held[-1]:
                break
            below += r["n"]
        if (r["low"], r["high"]) == (low, high):  # as close as numbers come
            break
        low, high = r["low"], r["high"]
    return low


def infer(scanned: DataFrame, params: SecretParams = SecretParams()) -> Formats:
    """Automata of the shapes of all distinct credentials of each kind, and of all other long tokens."""
    shaped = F.pandas_udf(lambda values: values.map(shape), T.StringType())
    base = scanned.select(F.explode("base").alias("s")).select("s.kind", "s.value").distinct()
    base = stored(base.select("kind", shaped("value").alias("shape")).groupBy("kind", "shape").agg(F.count(F.lit(1)).alias("n")),
                  "credential-shapes")
    automata, least = {}, {}
    for kind in KINDS[:3]:
        learnt = learn_shapes(base.where(F.col("kind") == kind).select("shape", "n"), "kind-shapes", params)
        if learnt:
            automata[kind], least[kind] = learnt
    others = learn_shapes(scanned.select(F.explode("shapes").alias("shape"), F.lit(1).alias("n")), "token-shapes", params)
    return Formats(params, automata, least, others[0] if others else Tally().automaton())


def scan(docs: DataFrame, params: SecretParams = SecretParams(), id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans``: arrays of (kind, start, end, value) by start, then kind.

    A null or empty text has no spans; without credentials no automaton is
    learnt and only base spans (none) remain. Repeated rows each get their row.
    """
    found = stored(scan_base(docs, id_col, text_col), "secret-candidates")
    formats = infer(found, params)
    arrow = to_arrow_schema(T.StructType([T.StructField("spans", T.ArrayType(SPAN))]))
    schema = T.StructType([found.schema["doc_id"], found.schema["base"], T.StructField("spans", T.ArrayType(SPAN))])
    names = SPAN.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            as_spans = lambda column: [[tuple(s[n] for n in names) for s in row] for row in column.to_pylist()]
            spans = [[dict(zip(names, s)) for s in all_spans(base, other, formats)]
                     for base, other in zip(as_spans(batch.column(1)), as_spans(batch.column(2)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, arrow.field(0).type)],
                                             names=["doc_id", "base", "spans"])

    return found.mapInArrow(run, schema)


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, mark: str = "[SECRET]", params: SecretParams = SecretParams(), id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with ``mark`` for each secret in the text; of an
    assignment only its value goes. A null text stays null."""
    formats = infer(stored(scan_base(docs, id_col, text_col), "secret-candidates"), params)

    @F.pandas_udf(T.StringType())
    def without_secrets(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None else redacted(v, formats, mark))

    return docs.withColumn(text_col, without_secrets(F.col(text_col)))


def redacted(text: str, formats: Formats, mark: str) -> str:
    base, tokens = base_spans(text)
    spans = all_spans(base, candidates(tokens), formats)
    parts, at = [], 0
    for start, end in sorted((end - len(value), end) for _, _, end, value in spans):
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], mark]
        at = end
    return "".join(parts) + text[at:] if parts else text
