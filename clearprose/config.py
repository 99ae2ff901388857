"""Rule configuration, resolved on the driver while a plan is built."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field

# Registered rule ids and their default severities. The three verb
# rules can be named but are never evaluated.
DEFAULT_SEVERITY = {
    "contraction": "hard",
    "dictionary-not-approved-word": "hard",
    "hedging": "soft",
    "invalid-suppression": "hard",
    "marketing": "soft",
    "paragraph-length": "hard",
    "phrasal-verb": "hard",
    "semicolon": "hard",
    "sentence-length": "hard",
    "verb-progressive": "hard",
    "verb-passive": "soft",
    "verb-perfect": "hard",
}
REGISTERED = tuple(DEFAULT_SEVERITY)
#: Order in which rules report; ties of line and column keep it.
RULE_ORDER = (
    "sentence-length", "paragraph-length", "contraction", "semicolon", "phrasal-verb",
    "hedging", "marketing", "dictionary-not-approved-word", "invalid-suppression",
)
MAX_SENTENCE_WORDS = 25
MAX_PARAGRAPH_SENTENCES = 6
PROSE_KINDS = ("prose-file", "commit-message")
SOURCE_KINDS = ("slash-source", "hash-source")


@dataclass(frozen=True)
class PhraseEntry:
    unapproved: tuple[str, ...]
    suggestions: tuple[str, ...] = ()


@dataclass(frozen=True)
class LintConfig:
    rules: dict[str, str] = field(default_factory=dict)
    max_sentence_words: int | None = None
    max_paragraph_sentences: int | None = None
    exempt_block_quotes: bool = False
    blacklist: tuple[PhraseEntry, ...] = ()
    whitelist: tuple[str, ...] = ()

    def severity(self, rule: str) -> str | None:
        """hard, soft, or None for off; a set value other than hard and soft is off."""
        value = self.rules.get(rule, DEFAULT_SEVERITY.get(rule))
        return value if value in ("hard", "soft") else None

    @property
    def sentence_words(self) -> int:
        return MAX_SENTENCE_WORDS if self.max_sentence_words is None else self.max_sentence_words

    def paragraph_sentences(self, kind: str) -> int:
        """Most sentences of a paragraph; 0 turns the rule off. Source kinds have none by default."""
        if self.max_paragraph_sentences is not None:
            return self.max_paragraph_sentences
        return MAX_PARAGRAPH_SENTENCES if kind in PROSE_KINDS else 0

    @property
    def exempt_forms(self) -> frozenset[str]:
        return frozenset(w.lower() for w in self.whitelist)


def from_toml(text: str) -> LintConfig:
    """A config from TOML; text that can't be read or has wrong types gives the defaults."""
    try:
        raw = tomllib.loads(text)
        entries = tuple(PhraseEntry(tuple(map(str, e["unapproved"])), tuple(map(str, e.get("suggestions", ())))) for e in raw.get("blacklist", ()))
        words = raw.get("whitelist", {})
        config = LintConfig(
            {str(k): v for k, v in raw.get("rules", {}).items()}, raw.get("max_sentence_words"), raw.get("max_paragraph_sentences"),
            raw.get("exempt_block_quotes", False), entries, tuple(words.get("words", ())),
        )
        numbers = (config.max_sentence_words, config.max_paragraph_sentences)
        if any(n is not None and (not isinstance(n, int) or n < 0) for n in numbers) or not all(isinstance(v, str) for v in config.rules.values()):
            return LintConfig()
        return config
    except (tomllib.TOMLDecodeError, KeyError, TypeError, AttributeError):
        return LintConfig()


def load(path: str | None = None, folder: str = ".") -> LintConfig:
    """The named file, else the folder's default file, else the defaults."""
    for candidate in (path, os.path.join(folder, ".simple-english.toml")):
        if candidate and os.path.isfile(candidate):
            with open(candidate, encoding="utf-8") as f:
                return from_toml(f.read())
    return LintConfig()
