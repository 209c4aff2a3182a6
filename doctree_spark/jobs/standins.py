"""Rule models that stand in for real ones in registered queries, so that SQL can say what comes out."""

from __future__ import annotations

WORDS = 12
#: A stand-in's call fails if a text in it has a length divisible by this; one divisible by ``LATER`` is answered when it is asked again.
BROKEN, LATER = 11, 7


def first_words() -> object:
    """Summaries: the first words of a context."""
    seen: set[str] = set()

    def said(texts: list[str]) -> list[str]:
        new = {t for t in texts if len(t) % LATER == 0} - seen
        seen.update(new)
        if any(len(t) % BROKEN == 0 for t in texts):
            raise ValueError("broken")
        return ["" if t in new else " ".join(t.split()[:WORDS]) for t in texts]

    return said


def sized_answers() -> object:
    """Answers: a prompt's temperature and length."""

    def said(pairs: list[tuple[str, float]]) -> list[str]:
        if any(len(p) % BROKEN == 0 for p, _ in pairs):
            raise ValueError("broken")
        return [f"{t:.1f} {len(p)}" for p, t in pairs]

    return said


def quarter_lengths() -> object:
    """Tokens: a quarter of a text's characters, rounded up."""
    return lambda texts: [-(-len(t) // 4) for t in texts]


def at_commas() -> object:
    """Sentences: what stands between commas."""
    return lambda texts: [t.split(",") for t in texts]


def by_length() -> object:
    """Labels and scores of questions, by their lengths."""
    return lambda texts: [(("broad", "definitional", "comparative")[len(t) % 3], len(t) % 10 / 10) for t in texts]
