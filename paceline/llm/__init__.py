"""Operators on texts, pages, vectors and archives, for training-data pipelines; nothing else imports this subpackage."""


def load_all() -> None:
    """Register the queries of this subpackage."""
    from paceline.llm import queries_new, queries_pages, queries_text  # noqa: F401
