"""Questions in words as semantic queries, without a language model.

Phrases of the model are looked for in the question, longest first, and what a phrase covers is used up. A question
that names no metric is answered by a question back. A language model may be given as a callable instead.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from .model import Model
from .plans.graph import dimensions_for
from .plans.query import Filter, SemanticQuery

STOP = frozenset("the a an of for by in on at to and or is are was were what which how many much show me give per with from".split())
CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]+")
GRAIN_WORDS = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year", "annual": "year", "day": "day", "week": "week", "month": "month", "quarter": "quarter", "year": "year"}


@dataclass(frozen=True)
class Clarify:
    question: str
    options: tuple[str, ...] = ()


def tokens(text: str) -> set[str]:
    """Words of two letters or more that aren't stop words, and pairs of neighbouring CJK characters."""
    out = {w for w in re.findall(r"[a-z0-9]+", text.lower()) if len(w) > 1 and w not in STOP}
    for run in CJK.findall(text):
        out |= {run[i : i + 2] for i in range(max(1, len(run) - 1))}
    return out


def retrieve(model: Model, question: str, k: int = 8) -> list[tuple[str, float]]:
    """Metrics by the share of the question's tokens that they have, names and synonyms counting twice."""
    q = tokens(question)
    out = []
    for m in model.metrics.values():
        own, more = tokens(" ".join((m.name.replace("_", " "), *m.synonyms))), tokens(m.description)
        score = (2 * len(q & own) + len(q & more)) / (3 * len(q)) if q else 0.0
        phrase = any(p.lower() in question.lower() for p in (m.name.replace("_", " "), *m.synonyms))
        union = len(q | own)
        out.append((m.name, 0.45 * score + 0.35 * phrase + 0.2 * (len(q & own) / union if union else 0)))
    return sorted((x for x in out if x[1] > 0), key=lambda x: (-x[1], x[0]))[:k]


#: BM25: how soon repeated tokens count less, and how much the length of a text counts; the constant of rank fusion.
K1, B, FUSE = 1.2, 0.75, 60


def bm25(texts: dict[str, str], question: str) -> list[tuple[str, float]]:
    """Names of texts that share tokens with the question, best first."""
    own = {n: Counter(w for w in re.findall(r"[a-z0-9]+", t.lower()) if w in tokens(t)) + Counter(tokens(t) - set(re.findall(r"[a-z0-9]+", t.lower()))) for n, t in texts.items()}
    mean = sum(map(Counter.total, own.values())) / max(len(own), 1) or 1
    out = []
    for n, c in own.items():
        score = 0.0
        for w in tokens(question) & c.keys():
            has = sum(w in x for x in own.values())
            score += math.log(1 + (len(own) - has + 0.5) / (has + 0.5)) * c[w] * (K1 + 1) / (c[w] + K1 * (1 - B + B * c.total() / mean))
        if score:
            out.append((n, score))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def fused(*rankings: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """Reciprocal ranks of several rankings, added up."""
    out: Counter = Counter()
    for r in rankings:
        for i, (n, _) in enumerate(r):
            out[n] += 1 / (FUSE + i + 1)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def retrieve_fused(model: Model, question: str, k: int = 8) -> list[tuple[str, float]]:
    """Metrics by the ranks that token shares and BM25 give them; those whose name or synonym stands in the question come first."""
    named = {m.name for m in model.metrics.values() if any(p.lower() in question.lower() for p in (m.name.replace("_", " "), *m.synonyms))}
    texts = {m.name: " ".join((m.name.replace("_", " "), *m.synonyms, m.description)) for m in model.metrics.values()}
    both = fused(retrieve(model, question, len(texts)), bm25(texts, question))
    return sorted(both, key=lambda x: x[0] not in named)[:k]


def exemplars(known: list[tuple[str, SemanticQuery]], question: str, k: int = 3, least: float = 0.2) -> list[tuple[str, SemanticQuery]]:
    """Answered questions whose tokens are most like the question's, by Jaccard; none below `least`."""
    q = tokens(question)
    scored = [(len(q & (t := tokens(x))) / max(len(q | t), 1), x, query) for x, query in known]
    return [(x, query) for s, x, query in sorted((y for y in scored if y[0] >= least), key=lambda y: (-y[0], y[1]))[:k]]


def phrases(model: Model) -> list[tuple[str, str, str]]:
    out = [(p.lower(), "metric", m.name) for m in model.metrics.values() for p in (m.name, m.name.replace("_", " "), *m.synonyms)]
    out += [(p.lower(), "dimension", d.name) for d in model.dimensions.values() for p in (d.name, d.name.replace("_", " "), *d.synonyms)]
    return sorted(set(out), key=lambda x: (-len(x[0]), x))


def ground(model: Model, question: str, llm: Callable[[str], SemanticQuery | None] | None = None) -> SemanticQuery | Clarify:
    if llm and (q := llm(question)) is not None:
        return q.canonical(model)
    text = question.lower()
    found: list[tuple[int, str, str]] = []
    for phrase, kind, name in phrases(model):
        pattern = re.escape(phrase) if CJK.search(phrase) else rf"(?<![a-z0-9]){re.escape(phrase)}(?![a-z0-9])"
        while m := re.search(pattern, text):
            found.append((m.start(), kind, name))
            text = text[: m.start()] + "\0" * (m.end() - m.start()) + text[m.end() :]
    metrics = tuple(dict.fromkeys(n for _, k, n in sorted(found) if k == "metric"))
    dims = tuple(dict.fromkeys(n for _, k, n in sorted(found) if k == "dimension"))
    grain = next((g for w, g in GRAIN_WORDS.items() if re.search(rf"\b{w}\b", text)), None)
    if not metrics:
        near = tuple(n for n, _ in retrieve(model, question, 3))
        return Clarify("Which measure do you mean?", near)
    if grain and not any(model.dimensions[d].type == "time" for d in dims):
        times = sorted(d for d in set.intersection(*(dimensions_for(model, m) for m in metrics)) if model.dimensions[d].type == "time")
        if len(times) > 1:
            return Clarify("By which date?", tuple(times))
        dims += tuple(times)
    return SemanticQuery(metrics, dims, time_grain=grain)


def follow_up(model: Model, before: SemanticQuery, question: str) -> SemanticQuery | Clarify:
    """A question that names a metric is a new one; else the metrics and filters stay and the dimensions are added."""
    q = ground(model, question)
    if isinstance(q, SemanticQuery):
        return q
    first = before.metrics[0]
    more = ground(model, f"{first} {question}")
    if isinstance(more, Clarify) or not (more.group_by or more.time_grain):
        return q
    return replace(before, group_by=tuple(dict.fromkeys((*before.group_by, *more.group_by))), time_grain=more.time_grain or before.time_grain)


@dataclass
class Conversation:
    """Turns of one caller: a question is new, goes on from the query before, or answers what was asked back."""

    model: Model
    before: SemanticQuery | None = None
    open: str = ""
    turns: list[tuple[str, SemanticQuery | Clarify]] = field(default_factory=list)

    def turn(self, question: str) -> SemanticQuery | Clarify:
        if self.open:
            out = ground(self.model, f"{self.open} {question}")
            if isinstance(out, Clarify):
                out = ground(self.model, question)
        elif self.before is not None:
            out = follow_up(self.model, self.before, question)
        else:
            out = ground(self.model, question)
        self.open = question if isinstance(out, Clarify) else ""
        if isinstance(out, SemanticQuery):
            self.before = out
        self.turns.append((question, out))
        return out


def critique(model: Model, question: str, q: SemanticQuery) -> tuple[str, str]:
    """pass, revise or ask, with the reason."""
    named = ground(model, question)
    if isinstance(named, SemanticQuery):
        if missing := [m for m in named.metrics if m not in q.metrics]:
            return "revise", f"the question names {missing}"
        if missing := [d for d in named.group_by if d not in q.group_by]:
            return "revise", f"the question asks by {missing}"
    bad = [d for d in q.group_by if any(d not in dimensions_for(model, m) for m in q.metrics)]
    return ("ask", f"{bad} can't slice {list(q.metrics)}") if bad else ("pass", "")


def settled(model: Model, question: str, q: SemanticQuery, revise: Callable[[str, SemanticQuery, str], SemanticQuery], retries: int = 2) -> SemanticQuery | Clarify:
    """Criticised and revised, twice at most, and never to a plan that was seen before."""
    seen = {q.key()}
    for _ in range(retries):
        what, why = critique(model, question, q)
        if what == "pass":
            return q
        if what == "ask":
            return Clarify(why)
        q = revise(question, q, why)
        if q.key() in seen:
            break
        seen.add(q.key())
    return q if critique(model, question, q)[0] == "pass" else Clarify("I can't make a query of this.")


def chained(steps: list[tuple[str, Callable[[dict[str, object]], DataFrame]]]) -> DataFrame:
    """Steps whose first value (row 1, column 1) the next ones may use by name; the last frame isn't run."""
    known: dict[str, object] = {}
    for i, (name, step) in enumerate(steps):
        df = step(known)
        if i == len(steps) - 1:
            return df
        row = df.head(1)
        known[name] = row[0][0] if row else None
    raise ValueError("no steps")


def filtered_by(dimension: str, value: object) -> tuple[Filter, ...]:
    return (Filter(dimension, "=", (value,)),)
