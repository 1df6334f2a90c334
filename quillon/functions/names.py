"""Scalar functions on symbol names and paths, all as built-in column expressions.

Matching by suffix (``a`` is called as ``m.a``) is an equality of keys:
``suffix_keys`` of the called name holds every dotted suffix, so the join is an
equi-join. Underscores and letter case match only themselves.
"""

from __future__ import annotations

import builtins
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_symbol(name: Column | str) -> Column:
    """The last segment after ``::`` and then after ``.``."""
    return F.substring_index(F.substring_index(F.trim(_col(name)), "::", -1), ".", -1)


def after_first_dot(name: Column | str) -> Column:
    """What follows the first dot; the name itself where there is none."""
    return F.regexp_replace(_col(name), r"^[^.]*\.", "")


def after_last_dot(name: Column | str) -> Column:
    return F.substring_index(_col(name), ".", -1)


def first_segment(name: Column | str) -> Column:
    return F.substring_index(_col(name), ".", 1)


def module_of(name: Column | str) -> Column:
    """The first two dotted segments."""
    return F.substring_index(_col(name), ".", 2)


def suffix_keys(name: Column | str) -> Column:
    """Every dotted suffix, the whole name first."""
    parts = F.split(_col(name), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def prefix_keys(name: Column | str) -> Column:
    """Every dotted prefix, the whole name last."""
    parts = F.split(_col(name), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))


def name_forms(name: Column | str) -> Column:
    """(name, name_type) structs: the surface form, and the bare form where it differs."""
    c = _col(name)
    surface = F.struct(c.alias("name"), F.lit("surface").alias("name_type"))
    bare = F.struct(normalize_symbol(c).alias("name"), F.lit("bare").alias("name_type"))
    return F.when(normalize_symbol(c) == c, F.array(surface)).otherwise(F.array(surface, bare))


def is_pseudo(name: Column | str) -> Column:
    """Names such as ``<lambda>``."""
    c = _col(name)
    return c.startswith("<") & c.endswith(">")


#: Segments that mark accessor chains.
ACCESSOR_SEGMENTS = ("self", "cursor", "cls", "ctx")
#: Names of Python's built-ins and of its standard library's modules, as the interpreter lists them.
PYTHON_BUILTINS = tuple(sorted(dir(builtins)))
STDLIB_MODULES = tuple(sorted(sys.stdlib_module_names))


def is_accessor_chain(name: Column | str) -> Column:
    """A segment of accessors in any case, or three segments and more with a middle one of at most two characters."""
    parts = F.split(F.lower(_col(name)), r"\.")
    middle = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.exists(parts, lambda p: p.isin(*ACCESSOR_SEGMENTS)) | ((F.size(parts) >= 3) & F.exists(middle, lambda p: F.length(p) <= 2))


def is_noise(name: Column | str) -> Column:
    """Empty, pseudo, built-in or accessor names."""
    c = _col(name)
    return F.coalesce((c == "") | c.startswith("<") | c.isin(*PYTHON_BUILTINS) | is_accessor_chain(c), F.lit(True))


def is_dunder(name: Column | str) -> Column:
    c = _col(name)
    return c.startswith("__") & c.endswith("__")


def is_test_path(path: Column | str) -> Column:
    return _col(path).rlike(r"(^|/)tests?/|(^|/)test_[^/]*$|_test\.[^./]*$")


def parent_directory(path: Column | str) -> Column:
    """The path up to its last slash; empty where there is none."""
    return F.regexp_extract(F.translate(_col(path), "\\", "/"), r"^(.*)/[^/]*$", 1)


def directory_key(path: Column | str, depth: int = 1) -> Column:
    """The first ``depth`` segments of the directory."""
    return F.substring_index(parent_directory(path), "/", depth)


def module_name(path: Column | str) -> Column:
    """A file's dotted module."""
    return F.translate(F.regexp_replace(F.regexp_replace(F.translate(_col(path), "\\", "/"), r"\.[^./]*$", ""), r"/__init__$", ""), "/", ".")


def file_of_module(module: Column | str, extension: str = ".py") -> Column:
    return F.concat(F.translate(_col(module), ".", "/"), F.lit(extension))


def name_tokens(name: Column | str) -> Column:
    """The parts of a snake-case name."""
    return F.filter(F.split(_col(name), "_+"), lambda t: t != "")


def naming_prefix(name: Column | str) -> Column:
    return F.get(name_tokens(name), F.lit(0))


def naming_suffix(name: Column | str) -> Column:
    tokens = name_tokens(name)
    return F.get(tokens, F.size(tokens) - 1)


def snake_case(name: Column | str) -> Column:
    """CamelCase to snake_case."""
    return F.lower(F.regexp_replace(_col(name), "([a-z0-9])([A-Z])", "$1_$2"))


#: Words that name no concept, and endings of architecture.
CONCEPT_SKIP = (
    "None", "True", "False", "Optional", "List", "Dict", "Any", "Union", "Query", "Get", "Set", "Use", "The", "This", "For", "Return", "Note", "Args", "Returns", "Raises", "Example",
    "Check", "Call", "Handle", "Active", "Current", "New", "Old", "Data", "Info", "Type")
CONCEPT_SUFFIXES = ("FSM", "Manager", "Engine", "System", "Controller", "Service", "Handler", "Registry", "Store", "State", "Model")
CONCEPT_COMPOUND = r"\b([A-Z][a-z]+(?:[A-Z][a-zA-Z0-9]+)+)\b"
CONCEPT_SUFFIXED = r"\b([A-Za-z][a-zA-Z0-9]*(?:FSM|Manager|Engine|Controller|Service|Handler|Registry|Store))\b"


def concepts(text: Column | str) -> Column:
    """Distinct concept names of a text: compound CamelCase words, then words with an ending of architecture."""
    c = F.coalesce(_col(text), F.lit(""))
    found = F.concat(F.regexp_extract_all(c, F.lit(CONCEPT_COMPOUND), F.lit(1)), F.regexp_extract_all(c, F.lit(CONCEPT_SUFFIXED), F.lit(1)))
    return F.filter(F.array_distinct(found), lambda w: ~w.isin(*CONCEPT_SKIP))


def prerequisites(text: Column | str) -> Column:
    """What a docstring says it is blocked on, requires, needs or depends on; distinct, in order, articles left out."""
    found = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(r"(?:blocked on|requires|needs|depends on)\s+(\w[\w#.]*)"), F.lit(1))
    return F.filter(F.array_distinct(found), lambda w: ~F.lower(w).isin("a", "an", "the", "this", "that", "to"))


#: Types that name no class of a corpus.
PRIMITIVE_TYPES = ("none", "nonetype", "any", "object", "str", "string", "int", "float", "bool", "bytes", "dict", "list", "tuple", "set", "frozenset", "optional", "union", "type")


def named_type(declared: Column | str) -> Column:
    """The class that a return type names: one generic unwrapped; primitives, several arguments and small letters give null."""
    c = F.trim(F.coalesce(_col(declared), F.lit("")))
    inner = F.regexp_extract(c, r"^\w+\[(.+)\]$", 1)
    bare = F.regexp_replace(F.when(inner != "", F.trim(inner)).otherwise(c), "^['\"]+|['\"]+$", "")
    return F.when((bare != "") & ~inner.contains(",") & ~F.lower(bare).isin(*PRIMITIVE_TYPES) & ~bare.rlike(r"^\p{Ll}"), bare)


def concept_base(name: Column | str) -> Column:
    """A name without its ending of architecture, if anything else is left."""
    return F.regexp_replace(_col(name), "^(.+)(" + "|".join(CONCEPT_SUFFIXES) + ")$", "$1")


def normalize_url(url: Column | str) -> Column:
    """Without query, fragment, scheme and host, and trailing slash; parameters are ``*``."""
    c = F.regexp_replace(_col(url), r"[?#].*$", "")
    c = F.regexp_replace(c, r"^[a-z]+://[^/]*", "")
    c = F.regexp_replace(c, r"<[^>]*>|\$\{[^}]*\}|\{[^}]*\}|:[A-Za-z_]\w*", "*")
    c = F.regexp_replace(c, "/+$", "")
    return F.when(c == "", "/").otherwise(c)


def url_matches(client: Column, pattern: Column) -> Column:
    """Equal number of segments, and each equal or a ``*`` on either side."""
    a, b = F.split(client, "/"), F.split(pattern, "/")
    same = F.forall(F.zip_with(a, b, lambda x, y: (x == y) | (x == "*") | (y == "*")), lambda ok: F.coalesce(ok, F.lit(False)))
    return (F.size(a) == F.size(b)) & same


#: Languages by file ending.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "c": "c", "h": "c", "cu": "cuda", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "zig": "zig", "lua": "lua"}


def language(path: Column | str) -> Column:
    pairs = [F.lit(x) for item in LANGUAGES.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(_col(path), r"\.([^./]*)$", 1)))


#: Roles of a few names.
SEMANTIC_ROLES = {"print": "runtime_noise", "str": "builtin_primitive", "sum": "builtin_primitive", "len": "builtin_primitive", "exec": "runtime_execution"}


def semantic_role(symbol: Column | str) -> Column:
    c = _col(symbol)
    known = F.create_map(*(F.lit(x) for item in SEMANTIC_ROLES.items() for x in item))
    named = F.try_element_at(known, F.lower(c))
    return (F.when(c.isNull() | (c == ""), "unknown").when(named.isNotNull(), named).when(F.lower(c).startswith("test_"), "test_code").when(c.startswith("<"), "runtime_artifact")
            .when(c.contains("."), "qualified_reference").when(c.rlike(r"^\p{Lu}"), "type_or_class").otherwise("general_symbol"))


def edge_role(caller: Column | str, callee: Column | str) -> Column:
    a, b = _col(caller), _col(callee)
    return (F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), "unknown").when(a.startswith("test_"), "test_execution").when(a.startswith("<"), "runtime_execution")
            .when(b.contains("."), "module_dependency").when(b.rlike("^[A-Z]"), "type_usage").otherwise("function_call"))


def symbol_class(name: Column | str, is_project: Column, resolved_by: Column) -> Column:
    """project, builtin (by its last segment), stdlib (by its first), runtime (resolved at run time or by alias) or unknown, in that order."""
    c = _col(name)
    return (F.when(F.coalesce(is_project, F.lit(False)), "project").when(after_last_dot(c).isin(*PYTHON_BUILTINS), "builtin").when(first_segment(c).isin(*STDLIB_MODULES), "stdlib")
            .when(resolved_by.isin("runtime", "alias"), "runtime").otherwise("unknown"))


#: Converters that the language's or a store's protocols call.
SERIAL_NAMES = ("to_dict", "from_dict", "to_json", "from_json", "to_yaml", "from_yaml", "serialize", "deserialize", "encode", "decode", "from_db", "to_db", "to_string", "from_string")
SERIAL_PREFIXES = ("from_", "to_")
DATA_ENDINGS = (".json", ".yaml", ".toml")


def entry_tier(name: Column, path: Column, is_tool: Column, http_route: Column) -> Column:
    """explicit_http, explicit_tool, protocol (dunders, converters, data files), test or inferred: the first that holds."""
    file = F.translate(path, "\\", "/")
    protocol = is_dunder(name) | name.isin(*SERIAL_NAMES)
    for p in SERIAL_PREFIXES:
        protocol = protocol | name.startswith(p)
    for e in DATA_ENDINGS:
        protocol = protocol | F.coalesce(file.endswith(e), F.lit(False))
    return (F.when(http_route.isNotNull() & (http_route != ""), "explicit_http").when(F.coalesce(is_tool, F.lit(False)), "explicit_tool")
            .when(protocol, "protocol").when(name.startswith("test_") | F.coalesce(file.contains("/test"), F.lit(False)), "test").otherwise("inferred"))


def canonical_id(path: Column, kind: Column, name: Column, line: Column) -> Column:
    return F.concat_ws(":", path, kind, name, line.cast("string"))
