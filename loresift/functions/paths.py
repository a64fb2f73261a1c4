"""What a path says about a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions whose files are taken for binary.
BINARY_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "ico", "webp", "bmp", "tiff", "pdf", "zip", "tar", "gz", "tgz", "bz2", "xz",
    "7z", "rar", "exe", "dll", "so", "dylib", "a", "o", "wasm", "class", "jar", "pyc", "pyo", "mp3", "mp4",
    "mov", "avi", "webm", "wav", "flac", "ogg", "ttf", "otf", "woff", "woff2", "eot", "psd", "ai", "sketch",
    "fig", "db", "sqlite", "parquet", "arrow", "lock", "bin",
)

# Language label and the extensions that carry it.
LANGUAGE_EXTENSIONS = {
    "rust": ("rs",),
    "python": ("py", "pyi",),
    "typescript": ("ts", "tsx",),
    "javascript": ("js", "jsx", "mjs", "cjs",),
    "go": ("go",),
    "java": ("java",),
    "kotlin": ("kt", "kts",),
    "swift": ("swift",),
    "c": ("c", "h",),
    "cpp": ("cc", "cpp", "cxx", "hh", "hpp", "hxx",),
    "csharp": ("cs",),
    "ruby": ("rb",),
    "php": ("php",),
    "scala": ("scala", "sc",),
    "clojure": ("clj", "cljs", "cljc",),
    "elixir": ("ex", "exs",),
    "erlang": ("erl", "hrl",),
    "haskell": ("hs",),
    "ocaml": ("ml", "mli",),
    "lua": ("lua",),
    "r": ("r",),
    "shell": ("sh", "bash", "zsh", "fish",),
    "sql": ("sql",),
    "html": ("html", "htm",),
    "css": ("css", "scss", "sass", "less",),
    "vue": ("vue",),
    "svelte": ("svelte",),
    "markdown": ("md", "markdown",),
    "yaml": ("yml", "yaml",),
    "toml": ("toml",),
    "json": ("json", "jsonc",),
    "xml": ("xml",),
    "proto": ("proto",),
    "graphql": ("graphql", "gql",),
    "terraform": ("tf", "hcl",),
    "dockerfile": ("dockerfile",),
    "make": ("makefile", "mk",),
}

# Language label of files known by their whole name.
LANGUAGE_FILE_NAMES = {"dockerfile": "dockerfile", "makefile": "make", "justfile": "just"}

# Largest file that is indexed, in bytes.
MAX_FILE_BYTES = 1_000_000

OTHER_LANGUAGE = "other"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the file name, ``''`` if there is none.

    A name whose only dot comes first (``.bashrc``) has no extension.
    """
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def _lookup(table: dict[str, str]) -> Column:
    pairs = [F.lit(item) for entry in table.items() for item in entry]
    return F.create_map(*pairs)


def language(path: Column) -> Column:
    """Language label by extension, else by file name, else ``other``.

    The lookup is a literal map, so it costs neither a join nor a shuffle.
    """
    by_extension = {ext: label for label, exts in LANGUAGE_EXTENSIONS.items() for ext in exts}
    ext = extension(path)
    by_name = F.try_element_at(_lookup(LANGUAGE_FILE_NAMES), F.lower(file_name(path)))
    found = F.when(ext == "", by_name).otherwise(F.try_element_at(_lookup(by_extension), ext))
    return F.coalesce(found, F.lit(OTHER_LANGUAGE))


def is_binary(path: Column) -> Column:
    return extension(path).isin(*BINARY_EXTENSIONS)


def is_hidden(rel_path: Column) -> Column:
    return rel_path.rlike(r"(^|/)\.")


def indexable_size(size_bytes: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    return size_bytes.between(1, max_bytes)


def relative_to(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 2**31 - 1)).otherwise(path)


def project_label(path: Column) -> Column:
    """Label of the project a transcript belongs to, from its parent folder.

    The folder name spells a path with dashes; leading dashes are dropped.
    """
    parent = F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))
    return F.translate(F.regexp_replace(parent, "^-+", ""), "-", "/")


def from_uri(uri: Column) -> Column:
    """Plain path of a ``file:`` or other URI as reported by file sources."""
    plain = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    # '+' is a literal in paths, while url_decode reads it as a blank
    return F.url_decode(F.regexp_replace(plain, r"\+", "%2B"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
