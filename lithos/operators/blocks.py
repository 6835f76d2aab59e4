"""Texts put together from fields: definitions, blocks of a prompt, prompts, output rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

EMPTY = ""


def labelled(label: str, c) -> Column:
    """`label` and the compact text; null where there is none, so that concat_ws leaves it out."""
    x = T.compact(c)
    return F.when(x != EMPTY, F.concat(F.lit(label), x))


def paragraph(json) -> Column:
    """A string, or the entries of a list joined by blanks."""
    return F.array_join(T.clean_list(T.scalar_or_list(json)), " ")


def first_entry(json) -> Column:
    """A string, or the first entry of a list; empty if there is none."""
    return F.coalesce(F.get(T.clean_list(T.scalar_or_list(json)), F.lit(0)), F.lit(EMPTY))


def guidance(llm_def, llm_add, most: int = 700) -> Column:
    """The generated definition and, unless that holds it, the added one."""
    a, b = T.compact(llm_def), T.compact(llm_add)
    return T.capped(F.trim(F.concat_ws(" ", F.nullif(a, F.lit(EMPTY)), F.when((b != EMPTY) & ~F.contains(a, b), b))), most, " ...")


def definition_with_comment(name, curated, comment, llm_def, llm_add, least: int = 60, gate: int = 120) -> Column:
    """struct(text, source): as files.definition_text, but a short curated definition with a comment
    gets the comment after it and then precedes all others (P11)."""
    c, m = T.compact(curated), T.compact(comment)
    pick = lambda x, s: F.struct(x.alias("text"), F.lit(s).alias("source"))
    short = F.length(c) < least
    return (
        F.when(short & (m != EMPTY) & (F.length(c) < gate), pick(F.concat(F.regexp_replace(c, r"\.+$", EMPTY), F.lit(". "), m), "curated_def+comment")).when(~short, pick(c, "curated_def"))
        .when(T.compact(llm_def) != EMPTY, pick(T.compact(llm_def), "llm_def")).when(T.compact(llm_add) != EMPTY, pick(T.compact(llm_add), "llm_add_def"))
        .when(T.compact(name) != EMPTY, pick(T.compact(name), "name_fallback")).otherwise(pick(F.lit("[EMPTY]"), "empty_fallback"))
    )


def short_definition(name, definition, llm_def, most: int = 320) -> Column:
    """Name, a full stop and the generated or else the given definition."""
    base = F.coalesce(F.nullif(T.compact(llm_def), F.lit(EMPTY)), T.compact(definition))
    return F.substring(F.trim(F.concat(T.compact(name), F.lit(". "), base)), 1, most)


def term_blocks(synonyms, definition, llm_add, ancestors) -> Column:
    """struct of the blocks a generation prompt takes; lists are joined by line feeds."""
    join = lambda c: F.array_join(F.coalesce(T.col(c), F.array().cast("array<string>")), "\n")
    return F.struct(join(synonyms).alias("synonyms_block"), F.coalesce(T.col(definition), F.lit(EMPTY)).alias("def_block"), F.coalesce(T.col(llm_add), F.lit(EMPTY)).alias("llm_add_def_block"), join(ancestors).alias("ancestor_names_block"))


def abstract_block(title, journal, year, authors, abstract, most: int = 1600) -> Column:
    """Title line, line of journal, year and authors, abstract."""
    meta = F.concat_ws(" | ", labelled("JOURNAL: ", journal), labelled("YEAR: ", year), labelled("AUTHORS: ", authors))
    return T.capped(F.concat_ws("\n", labelled("TITLE: ", title), F.nullif(meta, F.lit(EMPTY)), labelled("ABSTRACT:\n", abstract)), most, " ...")


def candidate_block(surface, unit, labels, context, most: int = 1800, options: int = 12) -> Column:
    """What was measured, then its context (P25)."""
    ctx = T.capped(T.compact(context), most, " ...")
    some = F.array_join(F.slice(F.coalesce(T.col(labels), F.array().cast("array<string>")), 1, options), ", ")
    meta = F.concat_ws("\n", labelled("SURFACE: ", surface), labelled("UNIT: ", unit), F.when(some != EMPTY, F.concat(F.lit("LABEL_OPTIONS: "), some)))
    return F.when(meta != EMPTY, F.rtrim(F.concat(meta, F.lit("\n\nCONTEXT:\n"), ctx))).otherwise(ctx)


def phenotype_block(members) -> Column:
    """members: array of struct(id, name)."""
    each = F.transform(T.col(members), lambda m: F.concat(F.lit("- ID: "), m["id"], F.lit("\n  Name: "), F.coalesce(m["name"], F.lit(EMPTY))))
    return F.rtrim(F.concat_ws("\n", F.lit("PHENOTYPES:"), F.array_join(each, "\n")))


def concatenated(name, lists: list, each: int = 6) -> Column:
    """The name and up to `each` phrases of each list (P20)."""
    parts = F.concat(F.array(T.col(name)), *[F.slice(T.col(x), 1, each) for x in lists])
    return T.compact(F.array_join(F.filter(parts, lambda x: x != EMPTY), " ; "))


LINE_KEYS = "output_lines output_lines_sanitized lines evidence_lines medium_lines b2_lines unit_lines b2_units units".split()
UNIT_KEYS = "output_lines output_lines_sanitized lines unit_lines b2_units units medium_lines".split()


def line_source(json) -> Column:
    """struct(lines, source): the lines under the first key present, at the top, else in B2 or b2, else
    in from_b1 or from_B1 (P16)."""
    j = T.col(json)
    places = [([k], k) for k in LINE_KEYS] + [([t, k], f"{t}.{k}") for t in ("B2", "b2") for k in UNIT_KEYS] + [([t, k], f"{t}.{k}") for t in ("from_b1", "from_B1") for k in LINE_KEYS[:3]]
    out = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("NOT_FOUND").alias("source"))
    for path, tag in reversed(places):
        v = F.get_json_object(j, "$." + ".".join(path))
        out = F.when(v.isNotNull(), F.struct(T.clean_list(T.scalar_or_list(v)).alias("lines"), F.lit(tag).alias("source"))).otherwise(out)
    return out


def unit_source(json) -> Column:
    """struct(lines, source): canonical phrase, supporting sentence and the lines of from_b1, else of the
    first key with any (P17)."""
    j = T.col(json)
    get = lambda path: F.get_json_object(j, "$." + path)
    own = F.concat(F.filter(F.array(T.compact(get("canonical_phrase")), T.compact(get("support_sentence"))), lambda x: x != EMPTY), T.clean_list(T.scalar_or_list(get("from_b1.output_lines"))))
    out = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("NOT_FOUND").alias("source"))
    for k in ("medium_lines", "evidence_lines", "lines", "output_lines"):
        v = T.clean_list(T.scalar_or_list(get(k)))
        out = F.when(F.size(v) > 0, F.struct(v.alias("lines"), F.lit(k).alias("source"))).otherwise(out)
    return F.when(F.size(own) > 0, F.struct(own.alias("lines"), F.lit("canonical+support+from_b1.output_lines").alias("source"))).otherwise(out)


def prompt(template: str, values: dict[str, Column | str], block: list[tuple[str, Column | str]]) -> Column:
    """T.filled; a template without any of the fields gets them after it, under INPUT, in the order of
    block: (label, value), the last as a paragraph of its own (X19)."""
    if any("{" + k + "}" in template for k in values):
        return T.filled(template, values)
    text = lambda v: F.coalesce(T.col(v).cast("string"), F.lit(EMPTY))
    *head, (label, body) = block
    lines = [F.concat(F.lit(f"[{k}] "), text(v)) for k, v in head]
    return F.concat(F.lit(template.rstrip() + "\n\nINPUT:\n"), F.concat_ws("\n", *lines), F.lit(f"\n\n[{label}]\n"), text(body), F.lit("\n\nOUTPUT:\n"))


def numbered_list(items, first: str, then: str, most: int = 6) -> Column:
    return F.concat(F.lit(first), F.array_join(F.slice(T.clean_list(items), 1, most), "\n" + then))


def unit_prompt(term_id, name, definition, llm_def, phrases, sentences, task: str) -> Column:
    """Prompt for a verdict on phrase candidates and sentences; task says what to answer."""
    return F.concat_ws(
        "\n", F.concat(F.lit("HPO_ID: "), T.col(term_id)), F.concat(F.lit("HPO_NAME: "), T.compact(name)), F.concat(F.lit("DEFINITION: "), short_definition(name, definition, llm_def)),
        F.lit("PHRASE_CANDIDATES:"), numbered_list(phrases, "- ", "- "), F.lit("CANDIDATE_SENTENCES:"), numbered_list(sentences, "1) ", "2) "), F.lit("\n" + task),
    )


def task_prompt(task, term_id, name, context, extra, rules: str) -> Column:
    """A task's fields as one JSON line, the context, and the rules of the answer."""
    meta = F.to_json(F.struct(T.col(task).alias("task"), T.col(term_id).alias("hpo_id"), T.col(name).alias("hpo_name"), T.col(extra).alias("extra")))
    return F.concat(F.lit("INPUT_META="), meta, F.lit("\n\nCONTEXT:\n"), F.coalesce(T.col(context), F.lit(EMPTY)), F.lit("\n\n" + rules))


def evidence_row(source, weak: str = "pubmed") -> Column:
    """Strength of the evidence by the kind of document."""
    return F.when(T.col(source) == weak, F.lit("weak")).otherwise(F.lit("strong"))
