"""Predicates and projections of file paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, endings and folders that rank a file.
LEGAL_STARTS, LEGAL_NAMES = ["license", "copying"], ["notice", "authors", "patents", "copyright"]
PROSE = ["md", "mdx", "markdown", "rst", "txt"]
TEST_MARKS, TEST_DIRS = [".test.", ".spec.", "_test."], ["test", "tests", "__tests__", "spec", "specs"]
CONFIG_ENDS = ["json", "yaml", "yml", "toml", "lock", "ini", "cfg"]
SAMPLE_DIRS = ["examples", "example", "fixtures", "testdata", "benchmark", "benchmarks"]

# Configuration files that hold conventions.
CONVENTION_NAMES = [".editorconfig", "rustfmt.toml", ".rustfmt.toml", "clippy.toml", "contributing.md", "pyproject.toml", "setup.cfg", ".pylintrc", "tsconfig.json", ".gitattributes"]
CONVENTION_STARTS = [".eslintrc", ".prettierrc"]

# Files that are not indexed.
LOCK_FILES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "Cargo.lock", "bun.lockb"]
ASSET_ENDS = [".min.js", ".map", ".svg", ".png", ".gif", ".jpg", ".jpeg", ".ico", ".webp", ".woff", ".woff2", ".ttf", ".eot", ".pdf", ".mp3", ".mp4", ".wav"]
MAX_BYTES = 256_000

# Languages by the ending of a file.
LANGUAGES = {
    "rust": ["rs"], "python": ["py", "pyi"], "javascript": ["js", "jsx", "mjs", "cjs"], "typescript": ["ts", "mts", "cts"], "tsx": ["tsx"], "go": ["go"],
    "kotlin": ["kt", "kts"], "java": ["java"], "c": ["c"], "cpp": ["cc", "cpp", "cxx", "c++", "hpp", "hh", "hxx", "h"],
}


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _any(flags) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def path_prior(path: Column) -> Column:
    """Weight of a file in code search: legal, prose, test, configuration and sample files count less."""
    low = ascii_lower(path)
    base, segments = basename(low), F.split(low, "/")
    end = F.substring_index(base, ".", -1)
    within = lambda names: F.arrays_overlap(segments, F.array(*map(F.lit, names)))
    return (
        F.when(_any(base.startswith(s) for s in LEGAL_STARTS) | base.isin(LEGAL_NAMES), 0.4)
        .when(end.isin(PROSE), 0.5)
        .when(_any(low.contains(m) for m in TEST_MARKS) | within(TEST_DIRS), 0.6)
        .when(base.startswith(".env") | end.isin(CONFIG_ENDS) | within(SAMPLE_DIRS), 0.7)
        .otherwise(1.0)
    )


def is_config_file(path: Column) -> Column:
    base = ascii_lower(basename(path))
    return base.isin(CONVENTION_NAMES) | _any(base.startswith(s) for s in CONVENTION_STARTS)


def should_index(path: Column, n_bytes: Column) -> Column:
    low = ascii_lower(path)
    return (n_bytes <= MAX_BYTES) & ~basename(path).isin(LOCK_FILES) & ~_any(low.endswith(e) for e in ASSET_ENDS)


def dir_key(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.regexp_extract(path, "(?s)^(.*)/[^/]*$", 1))


def lang_for_path(path: Column) -> Column:
    end = ascii_lower(F.substring_index(path, ".", -1))
    out = F.lit(None).cast("string")
    for name, ends in LANGUAGES.items():
        out = F.when(end.isin(ends), name).otherwise(out)
    return out
