"""What models are asked, and how a template is filled: braces other than the named ones are text."""

from __future__ import annotations

PROFILE = """Look at this converted document and find line patterns that show its structure.
Answer with JSON only: {"document_type": "...", "document_class": "...", "confidence": 0.0, "discovered_rules":
[{"type": "heading" or "regex_replace", "pattern": "...", "level": 1, "replacement": "...", "description": "..."}]}.
Rules that hold already:
{existing_rules_json}
Document:
{document_text}
"""
REVIEW = """Remove rules that say the same as another one. Answer with the whole profile as JSON only.
{profile_json}
"""
REQUIREMENTS = """List the concrete duties, prohibitions, conditions and deadlines of this text; invent none.
Answer with JSON only: {"requirements": [{"id": "...", "topic": "...", "requirement": "...", "must_cover": [], "conditions": [],
"deadline": null, "responsible_party": null, "severity": "low|medium|high|critical", "source_section": "...", "source_quote": "..."}]}.
Article: {article_id}
Header: {header_path}
Text:
{article_text}
"""
_CITE = "Answer from the numbered sources alone and cite them by number, as in [1]; say so if none helps.\n"
ANSWER = "Context:\n{context_str}\nAnswer the question from the context, not from what you know.\nQuestion: {query_str}\nAnswer: "
REFINE = "Question: {query_str}\nAnswer so far: {existing_answer}\nMore context:\n{context_msg}\nImprove the answer with it, or repeat the answer.\nAnswer: "
SUMMARY = "Sources:\n{context_str}\nAnswer the question from the sources.\nQuestion: {query_str}\nAnswer: "
CITE_ANSWER, CITE_REFINE, SIMPLE = _CITE + ANSWER, _CITE + REFINE, "{query_str}"

#: Template by mode family and step, for completion models; chat models get the same as messages.
TEMPLATES = {("cite", "answer"): CITE_ANSWER, ("cite", "refine"): CITE_REFINE, ("", "answer"): ANSWER, ("", "refine"): REFINE, ("", "summary"): SUMMARY, ("", "simple"): SIMPLE}


def fill(template: str, **values: str) -> str:
    """The template with {name} replaced for each value, once over, so that braces in values stay."""
    out, at = [], 0
    while (start := template.find("{", at)) >= 0:
        end = template.find("}", start)
        if end > 0 and template[start + 1 : end] in values:
            out += [template[at:start], values[template[start + 1 : end]]]
            at = end + 1
        else:
            out.append(template[at : start + 1])
            at = start + 1
    return "".join([*out, template[at:]])


def select(mode: str, step: str, chat: bool = False) -> str | list[dict]:
    """The template of a step (answer, refine, summary, simple) in a mode; for a chat model as system and user messages."""
    text = TEMPLATES.get(("cite" if mode.startswith("cite") else "", step), TEMPLATES["", step])
    if not chat:
        return text
    system = text[: len(_CITE)] if text.startswith(_CITE) else "Answer from what you are given."
    return [{"role": "system", "content": system.strip()}, {"role": "user", "content": text.removeprefix(_CITE)}]


def bare(mode: str, step: str) -> str:
    """The sources, or the question, alone."""
    return {"answer": "{context_str}", "refine": "{existing_answer}\n{context_msg}", "summary": "{context_str}", "simple": "{query_str}"}[step]
