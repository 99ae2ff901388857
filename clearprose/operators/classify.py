"""Content kind of a path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("prose-file", "slash-source", "hash-source", "commit-message", "skip")

# Extensions by kind.
SKIP = (
    "css scss less json jsonc svg xml typ csv tsv lock gz zip tar bz2 xz 7z rar png jpg jpeg gif webp bmp ico "
    "tiff pdf bin exe so dylib wasm o a class jar pyc db sqlite"
).split()
SLASH = "rs go java c h cpp hpp cc cs swift kt scala ts tsx js jsx mjs cjs".split()
HASH = "sh bash zsh py rb yaml yml toml pl nix".split()


def path_kind(path: Column) -> Column:
    """Legal texts and data are skipped; a path without a dot is its own extension; prose is the default."""
    lower = F.lower(path)
    base = F.substring_index(lower, "/", -1)
    extension = F.substring_index(lower, ".", -1)
    legal = (base == "license") | base.startswith("license.") | base.startswith("copying")
    return (
        F.when(legal | extension.isin(SKIP), "skip")
        .when(extension.isin(SLASH), "slash-source")
        .when(extension.isin(HASH), "hash-source")
        .otherwise("prose-file")
    )


def kind_override(name: str) -> str:
    """A kind that a user may name; skip isn't one."""
    if name not in KINDS[:4]:
        raise ValueError(f"unknown kind: {name}")
    return name
