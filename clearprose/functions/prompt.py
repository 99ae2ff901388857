"""Prompt fragments that state the rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearprose.config import DEFAULT_SEVERITY, LintConfig

# The summary's sections and lines.
SECTIONS = {
    "ASD-STE100 Simplified Technical English": {
        "contraction": "Do not use contractions. Write the words in full.",
        "dictionary-not-approved-word": "Use approved words from the STE dictionary.",
        "paragraph-length": "Use no more than six sentences in one paragraph.",
        "phrasal-verb": "Use an approved single-word verb instead of a phrasal verb.",
        "semicolon": "Do not use semicolons in prose. Write two sentences. Code fences are exempt.",
        "sentence-length": "Keep each sentence to {} words or fewer.",
        "verb-progressive": "Do not use progressive verb forms.",
        "verb-passive": "Prefer active voice.",
        "verb-perfect": "Do not use perfect verb forms.",
    },
    "Directive validation": {"invalid-suppression": "Name registered rule IDs in suppression directives."},
    "House-style rules": {"hedging": "Remove hedging phrases.", "marketing": "Use factual language instead of marketing language."},
}
CLOSING = "Writes, edits, and git commit messages reject hard violations. Correct the reported text and retry. Soft violations produce warnings."


def rule_summary(config: LintConfig) -> str:
    """Markdown of the rules; a rule set to off is left out, but for the sentence length."""
    parts = []
    for title, rules in SECTIONS.items():
        shown = [f"- [{DEFAULT_SEVERITY[r]}] {text.format(config.sentence_words)}" for r, text in rules.items() if config.rules.get(r) != "off" or r == "sentence-length"]
        if shown:
            parts.append(f"### {title}\n\n" + "\n".join(shown))
    body = "Apply these enabled rules to prose that you write or edit:\n\n" + "\n\n".join(parts) if parts else "No writing rules are enabled."
    return f"## Writing rules\n\n{body}\n\n{CLOSING}"


def with_fragment(fragments: Column, name: str, text: str) -> Column:
    """Fragments (arrays of name and text) with this one last and only once; null stays null."""
    own = F.array(F.lit(name), F.lit(text))
    return F.concat(F.filter(fragments, lambda f: F.get(f, F.lit(0)) != name), F.array(own))
