"""Routing of a question to retrieval strategies."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.providers import Chat, complete_json

# Keywords that send a question to facts and text, or to a base.
FACT_WORDS = ("code", "number", "phone", "address", "email", "birthday", "password", "pin", "key", "date", "price", "cost")
BASE_WORDS = ("places", "media", "books", "movies", "restaurants", "music")
STRATEGIES = ("semantic", "text", "facts", "frontmatter", "base", "graph")
#: Strategies of the keyword routing in their order, each with the words that call for it (none: always).
CALLED_BY = {"semantic": (), "facts": FACT_WORDS, "text": FACT_WORDS, "base": BASE_WORDS}


@dataclass
class Step:
    name: str
    params: dict = field(default_factory=dict)


def fallback(query: str) -> list[Step]:
    """The keyword routing of one question."""
    low = query.lower()
    names = [n for n, words in CALLED_BY.items() if not words or any(w in low for w in words)]
    return [Step(n, {"pattern" if n == "text" else "query": query}) for n in names]


def routed(query: Column) -> Column:
    """The keyword routing of a column of questions: an array of strategy names."""
    low = F.lower(query)
    return F.array_compact(F.array(*[F.when(low.rlike("|".join(w)) if w else F.lit(True), F.lit(n)) for n, w in CALLED_BY.items()]))


def route(query: str, chat: Chat | None = None) -> list[Step]:
    """A model's choice of strategies, or the keyword routing when there is none or it fails."""
    if chat is None:
        return fallback(query)
    prompt = "Choose retrieval strategies for the question. Reply as JSON with classification, strategies (name, params) and reasoning."
    try:
        reply = complete_json(chat, "router", [{"role": "system", "content": prompt}, {"role": "user", "content": query}])
        return [Step(s["name"], s.get("params") or {}) for s in reply["strategies"] if s.get("name") in STRATEGIES] or fallback(query)
    except Exception:  # any failure of a remote model means the documented fallback
        return fallback(query)
