"""Scalar text functions over source code, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language by file extension.
LANGUAGES = {
    "Python": ".py .pyi", "JavaScript": ".js .jsx .mjs .cjs", "TypeScript": ".ts .tsx", "Java": ".java", "C": ".c .h", "C++": ".cpp .hpp .cc .cxx",
    "C#": ".cs", "Go": ".go", "PHP": ".php", "Ruby": ".rb", "Rust": ".rs", "Kotlin": ".kt .kts", "Swift": ".swift", "Scala": ".scala", "SQL": ".sql",
    "Shell": ".sh .bash", "Dart": ".dart", "R": ".r", "Lua": ".lua", "Objective-C": ".m", "Objective-C++": ".mm", "Groovy": ".groovy",
    "Elixir": ".ex .exs", "Haskell": ".hs", "Julia": ".jl",
}
#: The validator's language names.
VALIDATED = {"python": ".py", "javascript": ".js .jsx", "typescript": ".ts .tsx", "java": ".java", "c": ".c", "cpp": ".cpp", "csharp": ".cs", "go": ".go", "php": ".php"}


#: The characters that Unicode calls white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def safe_text(value: Column) -> Column:
    """Text without white space around it; null is empty. Long texts are not searched for it, only their ends."""
    return F.coalesce(F.btrim(value.cast("string"), F.lit(WHITE)), F.lit(""))


def present(value: Column) -> Column:
    """The text, or null if it is blank."""
    return F.when(safe_text(value) != "", value)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def _lookup(path: Column, table: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for name, exts in table.items() for ext in exts.split() for x in (ext, name)])
    return F.coalesce(F.try_element_at(pairs, extension(path)), F.lit(default))


def language(path: Column) -> Column:
    return _lookup(path, LANGUAGES, "Unknown")


def validated_language(path: Column) -> Column:
    return _lookup(path, VALIDATED, "unknown")


def lines_of(source: Column) -> Column:
    """Lines, without the empty one after a final line end."""
    return F.split(F.regexp_replace(source, r"\n\z", ""), "\n", -1)


def line_text(source: Column, number: Column) -> Column:
    """The trimmed line of that number, or empty."""
    return F.coalesce(F.trim(F.try_element_at(lines_of(source), number)), F.lit(""))


def segment(source: Column, first: Column, last: Column) -> Column:
    """Whole lines first..last, joined and trimmed."""
    return safe_text(F.array_join(F.slice(lines_of(source), F.greatest(first, F.lit(1)), F.greatest(last - first + 1, F.lit(0))), "\n"))


def labelled(parts: list[tuple[str, Column]]) -> Column:
    """`Label: value` lines of the parts that are there; an empty label gives the value alone."""
    return F.concat_ws("\n", *[F.when(safe_text(v) != "", F.concat(F.lit(k), safe_text(v))) for k, v in parts])


def record_text(description: Column, error: Column, bug_type: Column, lang: Column, code: Column, solution: Column) -> Column:
    """What a knowledge-base record is embedded by."""
    return labelled([("", description), ("Error: ", error), ("Type: ", bug_type), ("Language: ", lang), ("Code: ", code), ("Solution: ", solution)])


def finding_query(error: Column, cause: Column, code: Column, bug_type: Column, context: Column) -> Column:
    """What similar records are looked up by in a scan: five lines, empty ones included."""
    return F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in (error, cause, code, bug_type, context)])


def labelled_query(file: Column, bug_type: Column, rule: Column, error: Column, cause: Column, code: Column) -> Column:
    """What the retriever looks a single finding up by: the fields that there are, each with its name."""
    return labelled([("File: ", file), ("Bug type: ", bug_type), ("Detection rule: ", rule), ("Error: ", error), ("Cause: ", cause), ("Code: ", code)])


def schema_text(description: Column, error: Column, code: Column) -> Column:
    """The short text of a knowledge-base record: description, error, code."""
    return labelled([("", description), ("Error: ", error), ("Code: ", code)])


def described_chunk(file: Column, lang: Column, kind: Column, name: Column, parent: Column, first: Column, last: Column, code: Column) -> Column:
    """A chunk as the text that it is embedded by; missing fields are empty."""
    there = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = [("File", there(file)), ("Language", there(lang)), ("Chunk type", there(kind)), ("Name", there(name)), ("Parent", there(parent)), ("Lines", F.concat(there(first), F.lit("-"), there(last)))]
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in rows], F.lit("Code:"), there(code))


def code_context(*candidates: Column) -> Column:
    """The first of the texts that is not blank, trimmed; empty if all are."""
    return F.coalesce(*[F.nullif(safe_text(c), F.lit("")) for c in candidates], F.lit(""))


def chunk_context(kind: Column, name: Column, first: Column, last: Column, code: Column) -> Column:
    return F.format_string("%s %s\nLines %d-%d\n%s", kind, name, first, last, code)


def chunk_id(file: Column, first: Column, last: Column, name: Column) -> Column:
    return F.format_string("%s:%d-%d:%s", file, first, last, name)


_QUOTED = r"""\"(?:\\.|[^\"\\])*+\"?|'(?:\\.|[^'\\])*+'?"""
#: Tokens of a text: strings, comments, code. A comment's end may use the star that opens it.
TOKENS = {
    "template": rf"""(?s)({_QUOTED}|`(?:\\.|[^`\\])*+`?|//[^\n]*+|/(?=\*).*?(?:\*/|\z)|[^\"'`/]++|/)""",
    "raw": rf"""(?s)({_QUOTED}|`[^`]*+`?|//[^\n]*+|/(?=\*).*?(?:\*/|\z)|[^\"'`/]++|/)""",
    "plain": rf"""(?s)({_QUOTED}|//[^\n]*+|/(?=\*).*?(?:\*/|\z)|[^\"'/]++|/)""",
}


#: How each extension's strings and templates are read; the others are "plain".
KINDS = {"template": ".js .jsx .ts .tsx .mjs .cjs".split(), "raw": [".go"]}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is computed once however often `use` names it: Catalyst writes a column out at each place."""
    return F.element_at(F.transform(F.array(value), use), 1)


def by_kind(path: Column, make: Callable[[str], Column]) -> Column:
    """make(kind) for the kind of a file's extension."""
    ext = extension(path)
    return F.when(ext.isin(KINDS["template"]), make("template")).when(ext.isin(KINDS["raw"]), make("raw")).otherwise(make("plain"))


def tokens(source: Column, kind: str = "template") -> Column:
    return F.regexp_extract_all(source, F.lit(TOKENS[kind]), F.lit(1))


def mask(source: Column, kind: str = "template") -> Column:
    """The text with strings and comments blanked, of the same length and with the same line ends; a template's closing
    quote stays. Quantifiers are possessive, so a string of any length needs no stack."""

    def blank(t: Column) -> Column:
        closed = t.rlike(r"(?s)^`.*`\z") & (F.char_length(t) > 1)
        empty = F.regexp_replace(t, r"[^\n]", " ")
        return F.when(closed, F.concat(F.substr(empty, F.lit(1), F.char_length(t) - 1), F.lit("`"))).when(t.rlike(r"^(?:[\"'`]|//|/\*)"), empty).otherwise(t)

    return F.array_join(F.transform(tokens(source, kind), blank), "")


def brackets(text: Column) -> Column:
    """The brackets of a text, in order."""
    return F.regexp_replace(text, r"[^()\[\]{}]", "")


def _even(b: Column) -> Column:
    count = lambda c: F.char_length(b) - F.char_length(F.replace(b, F.lit(c), F.lit("")))
    return (count("(") == count(")")) & (count("[") == count("]")) & (count("{") == count("}"))


def parity(source: Column, kind: str | None = "template") -> Column:
    """Whether each kind of bracket is opened as often as it is closed, outside strings and comments."""
    return let(brackets(mask(source, kind) if kind else source), _even)


def strip_line(line: Column) -> Column:
    """A line with its strings emptied and its // comment dropped."""
    for quote in ('"', "'", "`"):
        line = F.regexp_replace(line, rf"{quote}(?:\\.|[^{quote}\\])*+{quote}", quote * 2)
    return F.regexp_replace(line, r"//.*$", "")


def balance(code: Column, kind: str = "template") -> Column:
    """The first structural error of a code text, or null: an unexpected or mismatched closing bracket, an open string, an
    unclosed bracket. A fold over the brackets outside strings and comments keeps the stack as a string."""

    def step(stack: Column, b: Column) -> Column:
        top, opener = F.right(stack, F.lit(1)), F.translate(b, ")]}", "([{")
        return (
            F.when(stack.startswith("!"), stack)
            .when(b.isin("(", "[", "{"), F.concat(stack, b))
            .when(stack == "", F.lit("!unexpected_closing_bracket"))
            .when(top == opener, F.substr(stack, F.lit(1), F.char_length(stack) - 1))
            .otherwise(F.lit("!mismatched_bracket"))
        )

    def fault(end: Column, last: Column) -> Column:
        quote = F.substr(last, F.lit(1), F.lit(1))
        opened = quote.isin('"', "'", "`") & ((F.char_length(last) == 1) | (F.right(last, F.lit(1)) != quote) | last.rlike(r"(?s)^.(?:[^\\]|\\.)*\\.\z"))
        return F.when(end.startswith("!"), F.substr(end, F.lit(2))).when(opened, F.lit("unterminated_string")).when(end != "", F.lit("unclosed_bracket"))

    ends = lambda b: F.aggregate(F.regexp_extract_all(b, F.lit(r"(.)"), F.lit(1)), F.lit(""), step)
    last = F.coalesce(F.try_element_at(tokens(code, kind), F.lit(-1)), F.lit(""))
    return let(F.struct(let(brackets(mask(code, kind)), ends).alias("e"), last.alias("l")), lambda x: fault(x["e"], x["l"]))


def clean_json_fence(text: Column) -> Column:
    """A reply without the code fence around it."""
    return safe_text(F.regexp_replace(F.regexp_replace(safe_text(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))


#: Titles that stand alone on a line of a reply, those that may stand behind heading marks, words that label the
#: rest of their line, and words that name one thing.
TITLES = ["solution", "corrected code", "replacement code", "replace with this code", "explanation", "description", "reason", "cause"]
MARKED = ["corrected code", "solution", "replacement", "code"]
LABELS = ["function", "method", "file", "filename", "path"]
NAMING = ["function", "method", "class", "file"]


def commentary(line: Column) -> Column:
    """Whether a line of a reply tells about the code instead of being code: a title, a label with its value, a range of line
    numbers, a kind of thing with its name, or an order to use what follows."""
    flat = F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))
    unmarked = F.ltrim(F.regexp_replace(flat, "^#+", ""))
    marks = F.char_length(flat) - F.char_length(F.regexp_replace(flat, "^#+", ""))
    title = F.rtrim(F.regexp_replace(unmarked, ":$", ""))
    words = F.split(title, " ")
    first, rest = F.element_at(words, 1), F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    label, value = F.trim(F.substring_index(flat, ":", 1)), F.trim(F.substr(flat, F.instr(flat, F.lit(":")) + 1))

    is_title = F.when(marks == 0, title.isin(TITLES)).otherwise((marks <= 6) & unmarked.isin(MARKED))
    is_label = F.contains(flat, F.lit(":")) & label.isin(LABELS) & (value != "")
    # "lines: 3 - 9": nothing but two numbers and a dash is left
    numbers = F.when(first.isin("line", "lines", "line:", "lines:"), rest).when(label.isin("line", "lines"), value)
    numbers = F.replace(F.replace(F.ltrim(F.regexp_replace(numbers, "^:", "")), F.lit(" -"), F.lit("-")), F.lit("- "), F.lit("-"))
    dashed = F.split(F.translate(F.replace(numbers, F.lit(" "), F.lit("")), "–—", "--"), "-")
    is_range = (marks == 0) & (F.size(dashed) == 2) & F.forall(dashed, lambda x: (x != "") & (F.translate(x, "0123456789", "") == ""))
    named = (F.size(words) == 2) & first.isin(NAMING) & (F.translate(F.lower(rest), "abcdefghijklmnopqrstuvwxyz0123456789_$.-", "") == "") & ~F.left(rest, F.lit(1)).isin(*"0123456789.-")
    order = first.isin("replace", "use") & (F.element_at(words, -1) == "code") & F.array_except(words, F.array(*map(F.lit, ("replace", "use", "with", "this", "code")))).eqNullSafe(F.array().cast("array<string>"))
    return F.coalesce(is_title, F.lit(False)) | is_label | F.coalesce(is_range, F.lit(False)) | ((marks == 0) & ~F.endswith(flat, F.lit(":")) & named) | ((marks == 0) & order)


def clean_replacement(text: Column) -> Column:
    """Replacement code without code fences, lines of commentary and quotes around the whole."""
    body = F.filter(F.split(safe_text(text), "\n", -1), lambda x: ~F.startswith(F.ltrim(x), F.lit("```")))
    kept = F.filter(body, lambda x: ~commentary(x))
    code = F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\A(?:[ \t]*\n)+", ""), r"\s+\z", "")
    quoted = code.rlike(r"(?s)\A([\"']).*\1\z") & (F.char_length(code) > 1) & ~code.rlike(r"(?s)\A(.).*\1.*\1\z")
    return F.when(quoted, F.substr(code, F.lit(2), F.char_length(code) - 2)).otherwise(code)
