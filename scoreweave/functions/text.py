"""Texts, keys and codes. Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """use(value), with the value computed once and named, so that plans do not repeat it."""
    return F.get(F.transform(F.array(value), use), 0)


def words(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def has_words(text: Column, n: int) -> Column:
    """Whether there are n words or more; looks no further than these."""
    return F.regexp_like(F.coalesce(text, F.lit("")), F.lit(rf"(?U)(?:\S+\s+){{{n - 1}}}\S"))


def normalize_text(text: Column) -> Column:
    """Lower case, letters and digits of Portuguese only, single spaces."""
    kept = "a-z0-9áàâãéèêíïóôõöúçñ"
    # A single space is no match: it stays, and is by far the most frequent.
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^{kept}]{{2,}}|[^{kept} ]", " "))


def student_code(code: Column, *sources: Column) -> Column:
    """The given code, else one found in the sources in turn: digits after 'aluno', or two to four at the end; three places."""
    out = F.nullif(F.trim(F.coalesce(code, F.lit(""))), F.lit(""))
    for s in sources:
        s = F.coalesce(s, F.lit(""))
        for pattern in (r"(?iU)aluno\D*(\d{1,4})", r"(?U)(\d{2,4})\s*$"):
            found = F.nullif(F.regexp_extract(s, pattern, 1), F.lit(""))
            out = F.coalesce(out, F.when(found.isNotNull(), F.format_string("%03d", found.cast("int"))))
    return F.coalesce(out, F.lit(""))


def parse_qr(payload: Column, prefix: str = "MQPC") -> Column:
    """struct(exam_id, student_id, page, pages) of a well-formed page code, else null."""
    parts = F.split(F.trim(payload), r"\|")
    page, pages = F.trim(F.get(parts, 3)).try_cast("int"), F.trim(F.get(parts, 4)).try_cast("int")
    good = (F.size(parts) == 5) & (F.get(parts, 0) == prefix) & page.isNotNull() & pages.isNotNull()
    return F.when(good, F.struct(F.trim(F.get(parts, 1)).alias("exam_id"), F.trim(F.get(parts, 2)).alias("student_id"), page.alias("page"),
        pages.alias("pages")))


def format_qr(exam: Column, student: Column, page: Column, pages: Column, prefix: str = "MQPC") -> Column:
    return F.concat_ws("|", F.lit(prefix), exam, student, page, pages)


def first_valid_qr(payloads: Column) -> Column:
    """The first of several decoded codes that is well formed."""
    return F.get(F.filter(F.transform(payloads, parse_qr), lambda q: q.isNotNull()), 0)


def safe_uuid(text: Column) -> Column:
    """A uuid in lower-case canonical form, or null; braces, urn:uuid: and missing hyphens are accepted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), "urn:|uuid:", ""), r"^[{}]+|[{}]+$", "")

    def canonical(digits: Column) -> Column:
        at = lambda a, n: F.substring(digits, a, n)
        return F.when(F.regexp_like(digits, F.lit("^[0-9a-f]{32}$")), F.concat_ws("-", at(1, 8), at(9, 4), at(13, 4), at(17, 4), at(21, 12)))

    return let(F.lower(F.replace(bare, F.lit("-"), F.lit(""))), canonical)


def strip_code_fence(raw: Column) -> Column:
    """The text inside a code fence: without the first line, and without the last fence and what follows."""
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")

    def inside(text: Column) -> Column:
        inner = F.when(F.contains(text, F.lit("\n")), F.substr(text, F.instr(text, F.lit("\n")) + 1)).otherwise(text)
        cut = let(inner, lambda c: F.when(F.contains(c, F.lit("```")), F.regexp_replace(c, r"(?s)```(?!.*```).*$", "")).otherwise(c))
        return F.when(F.startswith(text, F.lit("```")), bare(cut)).otherwise(text)

    return let(bare(raw), inside)


def outer_braces(text: Column) -> Column:
    """From the first opening to the last closing brace, or the text as it is."""

    def cut(c: Column) -> Column:
        start, end = F.instr(c, F.lit("{")), F.length(c) - F.instr(F.reverse(c), F.lit("}")) + 1
        return F.when((start > 0) & F.contains(c, F.lit("}")) & (end > start), F.substr(c, start, end - start + 1)).otherwise(c)

    return let(text, cut)


def title_from_filename(name: Column, default: str = "Prova discursiva") -> Column:
    bare = F.regexp_replace(F.coalesce(F.nullif(name, F.lit("")), F.lit(default)), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.trim(F.replace(bare, F.lit("_"), F.lit(" "))), F.lit("")), F.lit(default))


def safe_pdf_name(name: Column) -> Column:
    base = F.replace(F.regexp_extract(name, r"([^/]*)/*$", 1), F.lit("\\"), F.lit("_"))
    return F.when(F.endswith(F.lower(base), F.lit(".pdf")), base).otherwise(F.concat(base, F.lit(".pdf")))


def join_texts(parts: Column, by: str = "\n") -> Column:
    """The parts that are not blank, trimmed, joined."""
    return F.array_join(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != "")), by)


def split_list(text: Column) -> Column:
    """The non-blank parts between commas, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")


def candidates(primary: Column, fallbacks: Column, default: str, excluded: list[str] = ()) -> Column:
    """Primary and fallbacks in order, each once, without blank and excluded ones; the default when none is left."""
    every = F.array_distinct(F.filter(F.concat(F.array(F.trim(F.coalesce(primary, F.lit("")))), split_list(fallbacks)),
        lambda m: (m != "") & ~m.isin(*excluded) if excluded else m != ""))
    return F.when(F.size(every) > 0, every).otherwise(F.array(F.lit(default)))


def token_overlap(a: Column, b: Column, distinct: Column | None = None) -> Column:
    """Share of the distinct tokens of a that b has too. distinct: their number, where it is known."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_distinct(a)) if distinct is None else distinct)


#: Names of fields in exam texts, after lower-casing and without i-acute, c-cedilla, a-tilde and o-tilde.
FIELD_NAMES = {
    "titulo": ("titulo da prova", "titulo"),
    "disciplina": ("disciplina",),
    "curso": ("curso",),
    "turma": ("turma",),
    "question_text": ("enunciado", "pergunta"),
    "expected_answer": ("resposta esperada", "gabarito", "padrao de resposta"),
    "correction_criteria": ("criterios", "criterios de correcao", "critérios", "rubrica"),
    "max_score": ("valor", "pontuacao"),
}
FIELD_PREFIXES = {"instrucoes": ("instrucoes",), "valor_padrao": ("valor padrao", "valor geral")}


def field_key(key: Column) -> Column:
    """The canonical field name of a label in an exam text, or the label itself."""
    raw = F.translate(F.lower(F.trim(key)), "íçãõ", "icao")
    out = raw
    for name, starts in FIELD_PREFIXES.items():
        for s in starts:
            out = F.when(F.startswith(raw, F.lit(s)), name).otherwise(out)
    for name, labels in FIELD_NAMES.items():
        out = F.when(raw.isin(*labels), name).otherwise(out)
    return out


def wrap_text(text: Column, most: int = 95) -> Column:
    """Lines of at most `most` characters, broken greedily between words."""
    longer = lambda cur, w: F.length(cur) + F.length(w) + 1 > most

    def step(acc, w):
        full = longer(acc["cur"], w)
        lines = F.when(full & (acc["cur"] != ""), F.concat(acc["lines"], F.array(acc["cur"]))).otherwise(acc["lines"])
        cur = F.when(full, w).otherwise(F.when(acc["cur"] == "", w).otherwise(F.concat_ws(" ", acc["cur"], w)))
        return F.struct(lines.alias("lines"), cur.alias("cur"))

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("cur"))
    return F.aggregate(words(text), start, step, lambda a: F.when(a["cur"] == "", a["lines"]).otherwise(F.concat(a["lines"], F.array(a["cur"]))))


#: Widths of the characters of Helvetica, in thousandths of the font's size (Adobe's core metrics). An accented
#: letter is as wide as its letter, an accented i as a dotless one; other characters count as OTHER_WIDTH.
HELVETICA = {
    191: "'",
    222: "ijl\u2018\u2019\u201a",
    260: "|",
    278: " !,./:;I[\\]ftÌÍÎÏìíîï\u00a0·",
    333: "()-`r\u00ad¡¨´\u201c\u201d\u201e‹›²³¹",
    334: "{}",
    355: '"',
    365: "º",
    370: "ª",
    389: "*",
    400: "°",
    469: "^",
    500: "Jcksvxyzçýÿšž",
    556: "#$0123456789?L_abdeghnopqu¢£¥§«»€¿àáâãäåèéêëñòóôõöùúûüµ–",
    584: "+<=>~¬±×÷",
    611: "FTZßøŽ",
    667: "&ABEKPSVXYÀÁÂÃÄÅÈÉÊËÝŠŸ",
    722: "CDHNRUwÇÑÙÚÛÜ",
    737: "©®",
    778: "GOQÒÓÔÕÖØ",
    833: "Mm",
    889: "%æ",
    944: "W",
    1000: "Æ…—Œ™",
    1015: "@",
}
OTHER_WIDTH = 556


def text_width(text: Column, widths: dict[int, str] = HELVETICA, other: int = OTHER_WIDTH) -> Column:
    """The width of a text's characters, in thousandths of the font's size.

    Each width counts the characters that have it by what is left of the text without them.
    """
    out = F.length(text) * other
    for width, chars in widths.items():
        if width != other:
            out = out + (F.length(text) - F.length(F.translate(text, chars, ""))) * (width - other)
    return out


def wrap_by_width(text: Column, most_pt: float, size_pt: float = 8, widths: dict[int, str] = HELVETICA) -> Column:
    """Lines of at most most_pt points, broken greedily between words; a wider word is a line of its own.

    Words are measured once each, and their places summed; a line's width is a difference of places.
    """
    most = int(most_pt * 1000 / size_pt + 1e-6)
    space = next((w for w, chars in widths.items() if " " in chars), OTHER_WIDTH)
    measured = F.transform(words(text), lambda w: F.struct(w.alias("w"), text_width(w, widths).cast("long").alias("n")))

    def step(acc, x):
        end = acc["end"] + space + x["n"]
        full = (acc["end"] >= 0) & (end > most)
        lines = F.when(full, F.concat(acc["lines"], F.array(acc["cur"]))).otherwise(acc["lines"])
        first = full | (acc["end"] < 0)
        cur = F.when(first, x["w"]).otherwise(F.concat_ws(" ", acc["cur"], x["w"]))
        return F.struct(lines.alias("lines"), cur.alias("cur"), F.when(first, x["n"]).otherwise(end).alias("end"))

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("cur"), F.lit(-1).cast("long").alias("end"))
    return F.aggregate(measured, start, step, lambda a: F.when(a["end"] < 0, a["lines"]).otherwise(F.concat(a["lines"], F.array(a["cur"]))))


def criteria_json(items: Column) -> Column:
    """JSON text of a list, null when it is empty."""
    return F.when(F.size(items) > 0, F.to_json(items))


def display_justification(text: Column) -> Column:
    """The justification, null when it is blank or reports a processing error."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    return F.when((plain != "") & ~F.startswith(F.lower(plain), F.lit("erro no processamento:")), plain)
