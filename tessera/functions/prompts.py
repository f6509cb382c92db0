"""Templates of prompts by name, filled without failing on keys that are not given, and the choice of one by provider."""

from __future__ import annotations

from datetime import datetime
from typing import Any

_TRIPLES = "Name each relation that the text states between two of its entities. Take entities as they are written, relations as short verb phrases in capitals (WORKS_FOR). Do not add what the text does not say."

TEMPLATES = {
    "rag_template": "Answer the question from the passages below alone. If they do not hold the answer, say that you do not know.\n\nPassages:\n{context}\n\nQuestion: {question}\n\nAnswer:",
    "context_chat": "Today is CURRENT_TIME. You continue a conversation. Use its history and the passages below; name a passage by its number when you rely on it.\n\nHistory:\n{history}\n\nPassages:\n{context}\n\nUser: {question}",
    "standalone_history": "Rewrite the last question so that it can be read without the conversation before it. Change nothing else; return the question alone.\n\nConversation:\n{history}\n\nQuestion: {question}",
    "search_queries": "Today is CURRENT_TIME. Suggest {n} short web searches that together would answer the question, as a JSON list of strings.\n\nQuestion: {question}",
    "coreference_resolution": "Replace pronouns and other references in the text by the names they stand for. Return the whole text, otherwise unchanged.\n\nText:\n{text}",
    "entity_extraction": "List the people, organisations, places, products, events and dates in the text, one a line as `name | type`.\n\nText:\n{text}",
    "entity_relationship_gleaning": "These relations were found in the text:\n{found}\n\nRead the text again and list, in the same form, relations that were missed.\n\nText:\n{text}",
    "entity_relationship_gleaning_continue": "Were relations missed in the last answer? Reply YES or NO alone.\n\n{found}",
    "relationship_extraction": _TRIPLES + " Known entities:\n{entities}\nRelations to prefer: {relationship_types}\n\nReturn one line a relation: subject | relation | object.\n\nText:\n{text}",
    "relationship_extraction_openai": _TRIPLES + " Known entities:\n{entities}\nRelations to prefer: {relationship_types}\n\nReturn JSON alone: {\"relationships\": [{\"subject\": \"\", \"relationship\": \"\", \"object\": \"\"}]}\n\nText:\n{text}",
    "relationship_extraction_claude": _TRIPLES + " Known entities:\n{entities}\nRelations to prefer: {relationship_types}\n\nReturn a Markdown table with the columns Subject, Relationship, Object.\n\n<text>\n{text}\n</text>",
}


def names() -> list[str]:
    return sorted(TEMPLATES)


def get(name: str, now: datetime | None = None) -> str:
    """A template by name; CURRENT_TIME stands for the time."""
    if name not in TEMPLATES:
        raise ValueError(f"no prompt {name!r}; known: {', '.join(names())}")
    return TEMPLATES[name].replace("CURRENT_TIME", (now or datetime.now()).strftime("%d %B %Y, %H:%M:%S"))


def fill(template: str, **values: Any) -> str:
    """The template with {key} replaced by what is given for it, once; other braces stay."""
    import re

    return re.sub(r"\{(\w+)\}", lambda m: str(values[m[1]]) if m[1] in values else m[0], template)


def choose(provider: str | None, overrides: dict[str, str] | None = None, default: str = "relationship_extraction") -> str:
    """Name of the template for a provider: what overrides say for it, else the default."""
    return (overrides or {}).get((provider or "").lower(), default)
