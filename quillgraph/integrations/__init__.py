"""Optional adapter to the framework ``langchain_core``."""

from __future__ import annotations

try:
    from langchain_core.documents import Document
    from langchain_core.retrievers import BaseRetriever
except ImportError:  # optional
    Document = BaseRetriever = None


def _need() -> None:
    if Document is None:
        raise ImportError("this adapter needs the package langchain_core")


def to_documents(results: list) -> list:
    """The framework's documents of results."""
    _need()
    return [Document(**r.to_document()) for r in results]


def retriever(engine, **settings):
    """A retriever of the framework that asks the engine."""
    _need()

    class Retriever(BaseRetriever):
        def _get_relevant_documents(self, query: str, *, run_manager=None) -> list:
            return to_documents(engine.query(query, **settings))

    return Retriever()
