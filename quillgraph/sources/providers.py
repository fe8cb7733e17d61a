"""Language-model providers for extraction: prompts, answers, retries.

A provider is any object with ``generate(prompt, system)`` that gives an
:class:`Answer`. Hosted ones are made by :func:`provider` from a function that
calls the service; none is built in, so nothing here needs a network.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

#: Dollars for a thousand tokens of input and of output.
PRICES = {"groq": (0.00005, 0.00008), "openai": (0.00005, 0.0004)}

EXTRACT = (
    "List the named entities (people, organisations, places, dates, products) and the key concepts (terms and topics of the field) of a passage."
    ' Answer with JSON only: {"entities": [...], "concepts": [...]}.'
)
QUERY = "List all entities, topics, terms and dates of a search query that would help to find documents. Answer with a JSON array of texts only."


@dataclass
class Answer:
    content: str
    model: str = ""
    tokens: int = 0
    cost: float = 0.0
    seconds: float = 0.0
    success: bool = True
    error: str | None = None


class Generator(Protocol):
    def generate(self, prompt: str, system: str = "") -> Answer: ...


def unfenced(answer: str) -> str:
    """An answer without the fences of a code block around it."""
    text = re.sub(r"^```(?:json)?", "", answer.strip())
    return re.sub(r"```$", "", text).strip()


def _texts(values: object) -> list[str]:
    return [str(v).strip() for v in values if v is not None and str(v).strip()] if isinstance(values, list) else []


def parse_extraction(answer: str) -> tuple[list[str], list[str]]:
    """Entities and concepts of an answer: JSON, or else lists of bullets under two headings."""
    text = unfenced(answer)
    try:
        data = json.loads(text)
        return (_texts(data.get("entities")), _texts(data.get("concepts"))) if isinstance(data, dict) else ([], [])
    except ValueError:
        pass
    out: dict[str, list[str]] = {"entities": [], "concepts": []}
    now = None
    for line in text.splitlines():
        head = re.match(r"\W*(entities|concepts)\b", line, re.I)
        if head:
            now = head.group(1).lower()
        elif now and (item := re.match(r"\s*(?:[-*•]|\d+[.)])\s*(.+)", line)):
            out[now].append(item.group(1).strip().strip("\"'"))
    return out["entities"], out["concepts"]


def parse_query(answer: str) -> list[str]:
    """Entities of a query's answer: a JSON list, a dict with ``entities``, or else the quoted texts; sorted, each once, of two letters or more."""
    try:
        data = json.loads(unfenced(answer))
        found = data if isinstance(data, list) else data.get("entities", []) if isinstance(data, dict) else []
    except ValueError:
        found = re.findall(r"[\"']([^\"']+)[\"']", answer)
    return sorted({e for e in _texts(found) if len(e) > 1})


def price(tokens: int, name: str, share: float = 0.6) -> float:
    """Dollars for so many tokens, ``share`` of them input."""
    a, b = PRICES[name]
    return tokens / 1000 * (share * a + (1 - share) * b)


class Called:
    """A provider that calls ``send(prompt, system) -> (text, tokens)``, several times if it fails, waiting twice as long each time."""

    def __init__(self, send: Callable[[str, str], tuple[str, int]], name: str, model: str, attempts: int = 3, wait: float = 1.0):
        self.send, self.name, self.model, self.attempts, self.wait = send, name, model, attempts, wait

    def generate(self, prompt: str, system: str = "") -> Answer:
        began = time.time()
        for attempt in range(self.attempts):
            try:
                text, tokens = self.send(prompt, system)
                return Answer(text, self.model, tokens, price(tokens, self.name), time.time() - began)
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
                if attempt + 1 < self.attempts:
                    time.sleep(self.wait * 2**attempt)
        return Answer("", self.model, 0, 0.0, time.time() - began, False, error)


def provider(name: str, send: Callable[[str, str], tuple[str, int]] | None = None, model: str | None = None, **more) -> Called:
    """A named provider; ``send`` makes the call, since no client of any service is built in."""
    if name not in PRICES:
        raise ValueError(f"unknown provider {name!r}; there are {sorted(PRICES)}")
    if send is None:
        raise RuntimeError(f"provider {name!r} needs a function that calls the service")
    return Called(send, name, model or f"{name}-default", **more)


def extractor(generator: Generator, context: dict | None = None) -> Callable[[str], tuple[list[str], list[str]]]:
    """What :func:`quillgraph.sources.cache.extract` takes: entities and concepts of a text by a provider; raises if it fails."""

    def run(text: str) -> tuple[list[str], list[str]]:
        about = "".join(f"\n{k}: {v}" for k, v in (context or {}).items())
        answer = generator.generate(f"Passage:\n{text}{about}", EXTRACT)
        if not answer.success:
            raise RuntimeError(answer.error)
        return parse_extraction(answer.content)

    return run


def query_extractor(generator: Generator) -> Callable[[str], list[str]]:
    """Entities of a query by a provider; raises if it fails, so that the caller can fall back on patterns."""

    def run(text: str) -> list[str]:
        answer = generator.generate(f"Query: {text}", QUERY)
        if not answer.success:
            raise RuntimeError(answer.error)
        return parse_query(answer.content)

    return run


def answer_question(generator: Generator, question: str, contents: list[str]) -> str:
    """An answer from retrieved passages; a fixed one if there are none."""
    if not contents:
        return "No passage was found to answer from."
    numbered = "\n\n".join(f"[{n}] {c}" for n, c in enumerate(contents, 1))
    answer = generator.generate(f"Passages:\n{numbered}\n\nQuestion: {question}", "Answer from the passages only and name their numbers.")
    if not answer.success:
        raise RuntimeError(answer.error)
    return answer.content
