"""Text heuristics as column expressions. Null text counts as empty unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens.functions.scalar import clamp, snap

# Phrases that make prose formal or informal, hedging words, the forms of "to be" before a participle.
FORMAL_PHRASES = ("furthermore", "moreover", "consequently", "utilize", "implement", "facilitate", "ensure", "comprehensive", "this pull request implements", "this pr addresses")
INFORMAL_PHRASES = ("gonna", "wanna", "kinda", "lol", "haha", "fix stuff", "fix things", "!!")
HEDGING = ("perhaps", "possibly", "might", "could", "may", "somewhat", "arguably", "likely", "unlikely", "presumably")
PASSIVE = r"(?i)\b(?:is|are|was|were|been|being)\s+\w+ed\b"
WORD = r"[a-zA-Z0-9]+(?:'[a-zA-Z]+)?"
# Contractions, pictures, abbreviations of chats.
CONTRACTION = r"(?U)\w'\w"
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{2702}-\x{27B0}\x{FE00}-\x{FE0F}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}]"
ABBREVIATION = r"(?i)\b(?:ASAP|FYI|AFAIK|IIRC|TBH|IMO|IMHO|BTW|WIP|LGTM|PTAL|TL;DR)\b"

# Titles that say nothing; those of the second list score no points.
GENERIC_TITLES = (
    r"^.{0,9}\z", r"(?i)^fix\s*(bug)?\z", r"(?i)^update[sd]?\z", r"(?i)^change[sd]?\z", r"(?i)^wip\z", r"(?i)^test\z",
    r"(?i)^refactor\z", r"(?i)^hotfix\z", r"(?i)^merge\s", r"^[A-Z]+-\d+\z", r"^(feature|bugfix|hotfix)/", r"(?i)^dev(elop)?\z",
)
WORTHLESS_TITLES = (
    r"(?i)^.{0,9}\z", r"(?i)^fix\s*(bug)?\z", r"(?i)^update[sd]?\z", r"(?i)^change[sd]?\z",
    r"(?i)^wip\z", r"(?i)^test\z", r"(?i)^[A-Z]+-\d+\z", r"(?i)^(feature|bugfix|hotfix)/",
)
# First lines of commit messages that say nothing.
GENERIC_MESSAGES = (
    r"(?i)^(fix|update|add|change|remove|delete|refactor|clean ?up)\s*\z", r"(?i)^(fix|update|add)\s+(stuff|things|code|bug|issue)\z",
    r"(?i)^wip\z", r"(?i)^initial commit\z", r"(?i)^merge\s+branch", r"(?i)^[a-f0-9]{7,40}\z",
)
ID_ONLY = r"^[\s,;]*[A-Za-z]+-\d+(?:[\s,;]+[A-Za-z]+-\d+)*[\s,;]*\z"
LINK_ONLY = r"^(?:[ \t]*\[[A-Za-z][A-Za-z0-9]*-\d+\]\([^)]+\)\s*(?:[,;]\s*)?)+\z"

# What a description should speak of, with the points that each gives.
DESCRIPTION_SIGNALS = (
    (("what", "change", "add", "implement", "fix"), 0.5),
    (("why", "because", "reason", "in order to"), 0.5),
    (("task", "story", "issue", "ticket", "#"), 0.25),
    (("test", "verify", "check", "how to"), 0.25),
)
TASK_VERBS = (
    "create", "implement", "add", "fix", "update", "remove", "configure", "design", "test", "integrate",
    "refactor", "set up", "build", "handle", "validate", "display", "show",
)
TASK_SPECIFICS = (
    "endpoint", "screen", "page", "button", "field", "table", "model", "service", "controller", "repository",
    "view", "fragment", "activity", "api", "database", "layout", "menu", "dialog",
)

ERROR_PATTERNS = (("missing_symbol", "cannot find symbol"), ("missing_package", "package .* does not exist"), ("type_mismatch", "incompatible types"), ("syntax", "';' expected|illegal start"), ("timeout", "timed? ?out"), ("memory", "out of memory|heap space"))
# Comments that admit debt, by category; the first category found counts.
SATD_PATTERNS = (
    ("design", r"\bTODO\b|\bFIXME\b|\bHACK\b|\bXXX\b|\bWORKAROUND\b|quick\s+fix|ugly|temporary|refactor\s+this|needs?\s+refactoring|tech\s*debt|should\s+be\s+replaced|not\s+ideal"),
    ("requirement", r"\bTBD\b|to\s+be\s+determined|not\s+yet\s+implemented|placeholder|stub"),
    ("defect", r"\bBUG\b|\bFIXME\b.*bug|known\s+issue|doesn'?t\s+work|broken"),
    ("test", r"skip\s*test|disabled\s*test|@Ignore|@Disabled"),
    ("documentation", r"update\s+docs?|document\s+this|missing\s+docs?"),
)

# Words that say nothing about a title's subject (English, Spanish, Catalan).
STOP_WORDS = (
    "a", "an", "the", "and", "or", "of", "to", "for", "in", "on", "at", "with", "from", "by", "is", "are", "be", "it", "this", "that", "as", "use", "using", "make", "do",
    "el", "la", "los", "las", "un", "una", "unos", "unas", "y", "o", "de", "del", "al", "en", "con", "por", "para", "es", "son", "ser", "hacer", "usar",
    "els", "les", "uns", "unes", "i", "amb", "per", "fer",
    "page", "pagina", "pagines", "screen", "pantalla", "pantalles", "pdf", "json", "feature", "task", "story", "user", "usuario", "usuari",
)
# Title words of repairs, and of changes to what is there.
FIX_WORDS = ("fix", "fixes", "bugfix", "hotfix", "patch", "arregla", "arreglar", "corrige", "corregir", "correccion", "soluciona", "solucionar", "arregl", "correg", "correccio", "bug")
MODIFY_WORDS = (
    "modify", "update", "updates", "edit", "change", "changes", "refactor", "refactoring", "fix", "fixes", "bugfix", "hotfix", "extend", "improve",
    "modificar", "modificacion", "editar", "actualizar", "actualizacion", "cambiar", "cambio", "arreglar", "corregir", "correccion", "mejora", "mejorar", "extender",
    "modificacio", "actualitzar", "actualitzacio", "canviar", "canvi", "correccio", "millora", "millorar", "ampliar",
)
# Title words of each layer, by stack.
LAYER_WORDS = {
    "spring": {
        "spring_controller": ("controller", "controllers", "rest", "restcontroller", "endpoint", "endpoints", "route", "routes", "controlador", "controladora", "controladores", "ruta", "rutes", "rutas"),
        "spring_service": ("service", "services", "servicio", "servicios", "servei", "serveis"),
        "spring_repository": ("repository", "repositories", "repo", "dao", "repositorio", "repositorios", "repositori", "repositoris"),
        "spring_entity": ("entity", "entities", "model", "models", "entidad", "entidades", "modelo", "modelos", "entitat", "entitats"),
        "spring_dto_mapper": ("dto", "dtos", "mapper", "mappers", "converter", "converters", "serializer", "serializers"),
        "spring_config_security": (
            "security", "securityconfig", "jwt", "auth", "authentication", "seguridad", "seguretat", "config", "configuration", "configuracion", "configuracio",
            "filter", "filters", "filtro", "filtros", "filtre", "filtres",
        ),
    },
    "android": {
        "android_fragment": ("fragment", "fragments"),
        "android_layout": ("layout", "layouts", "xml"),
        "android_viewmodel": ("viewmodel", "viewmodels", "livedata", "stateflow", "flow"),
        "android_recyclerview": ("recycler", "recyclerview", "adapter", "adapters", "viewholder", "viewholders"),
        "android_retrofit": ("retrofit", "okhttp", "apiclient", "apiservice", "endpoint", "endpoints"),
        "android_room": ("room", "dao", "daos"),
        "android_repository": ("repository", "repositories", "repo", "repositorio", "repositorios", "repositori", "repositoris"),
        "android_activity": ("activity", "activities", "actividad", "actividades", "activitat", "activitats"),
        "android_navigation": ("navigation", "navgraph", "navcontroller", "navbar", "drawer", "navegacion", "navegacio"),
    },
}


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, with what follows an apostrophe."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?]+"), strip), lambda s: s != "")


def sentence_count(text: Column) -> Column:
    """How many ``sentences`` there are, without making them: each starts at its first mark that is no white space."""
    return F.regexp_count(text, F.lit(r"[^.!?\s][^.!?]*"))


def richness(text: Column) -> Column:
    """Distinct words by words; 0 without words."""
    t = tokens(text)
    return F.when(F.size(t) > 0, F.size(F.array_distinct(t)) / F.greatest(F.size(t), F.lit(1))).otherwise(F.lit(0.0))


def phrase_bits(text: Column) -> Column:
    """A bit for each formal, then each informal phrase that the text holds."""
    low = F.lower(text)
    bits = [F.when(low.contains(p), F.lit(1 << i)).otherwise(0).cast("bigint") for i, p in enumerate((*FORMAL_PHRASES, *INFORMAL_PHRASES))]
    return reduce(lambda a, b: a + b, bits)


def formality_of(n: Column, sentence_count: Column, bits: Column, passives: Column, hedges: Column) -> Column:
    """0 to 1: formal against informal phrases (``phrase_bits``), sentence length, passive forms and hedging words; phrases weigh more under 20 words. 0.5 without words. n: words."""
    n = n.cast("double")
    formal = F.bit_count(bits.bitwiseAND((1 << len(FORMAL_PHRASES)) - 1))
    informal = F.bit_count(bits) - formal
    phrase = F.when(formal + informal > 0, formal / F.greatest(formal + informal, F.lit(1))).otherwise(F.lit(0.5))
    length = clamp((n / F.greatest(sentence_count, F.lit(1)) - 5) / 30, 0.0, 1.0)
    rate = lambda count, unit: F.least(count / F.greatest(n / unit, F.lit(1.0)), F.lit(1.0))
    passive, hedging = rate(passives, 20), rate(hedges, 30)
    short = phrase * 0.75 + length * 0.10 + passive * 0.10 + hedging * 0.05
    long = phrase * 0.45 + length * 0.20 + passive * 0.20 + hedging * 0.15
    return F.when(n == 0, F.lit(0.5)).otherwise(clamp(F.when(n < 20, short).otherwise(long), 0.0, 1.0))


def hedges(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*HEDGING)))


def formality(text: Column) -> Column:
    """``formality_of`` one text."""
    text = F.coalesce(text, F.lit(""))
    words = tokens(text)
    return formality_of(F.size(words), sentence_count(text), phrase_bits(text), F.regexp_count(text, F.lit(PASSIVE)), hedges(words))


def is_generic_title(title: Column) -> Column:
    return F.coalesce(_any(strip(title), GENERIC_TITLES), F.lit(True))


def is_generic_message(message: Column) -> Column:
    """By the first line of a commit message."""
    return _any(F.substring_index(strip(F.coalesce(message, F.lit(""))), "\n", 1), GENERIC_MESSAGES)


def is_empty_description(body: Column, least: int = 20) -> Column:
    """Under ``least`` bytes or nothing but headings."""
    b = strip(F.coalesce(body, F.lit("")))
    return (F.octet_length(b) < least) | ~F.exists(F.split(b, "\n"), lambda line: (strip(line) != "") & ~strip(line).startswith("#"))


def is_id_only(body: Column) -> Column:
    """Nothing but task ids such as ab-12, apart by white space, commas or semicolons."""
    return F.coalesce(strip(body).rlike(ID_ONLY), F.lit(False))


def is_link_only(body: Column) -> Column:
    """Nothing but Markdown links whose text is a task id."""
    return F.coalesce(strip(body).rlike(LINK_ONLY), F.lit(False))


def text_flags(title: Column, body: Column) -> Column:
    """array<string> of EMPTY_BODY or else TASK_ID_ONLY_BODY, and GENERIC_TITLE, as they apply."""
    empty = is_empty_description(body)
    raised = F.array(
        F.when(empty, "EMPTY_BODY").when(is_id_only(body) | is_link_only(body), "TASK_ID_ONLY_BODY"),
        F.when(is_generic_title(title), "GENERIC_TITLE"),
    )
    return F.filter(raised, lambda f: f.isNotNull())


def title_score(title: Column) -> Column:
    """0 if under 5 bytes or worthless, else a ladder by bytes up to 2."""
    t = strip(F.coalesce(title, F.lit("")))
    n = F.octet_length(t)
    return F.when((n < 5) | _any(t, WORTHLESS_TITLES), F.lit(0.0)).when(n < 20, F.lit(1.0)).when(n < 30, F.lit(1.5)).when(n < 50, F.lit(1.75)).otherwise(F.lit(2.0))


def description_score(body: Column) -> Column:
    """0 if under 20 bytes or nothing but ids or links, else a base by bytes plus points for what it speaks of, 4 at most."""
    b = strip(F.coalesce(body, F.lit("")))
    n, low = F.octet_length(b), F.lower(b)
    base = F.when(n < 50, 0.5).when(n < 100, 1.0).when(n < 200, 1.5).when(n < 400, 2.0).otherwise(2.5)
    points = reduce(lambda a, s: a + F.when(_holds(low, s[0]), s[1]).otherwise(0.0), DESCRIPTION_SIGNALS, base)
    return F.when((n < 20) | is_id_only(b) | is_link_only(b), F.lit(0.0)).otherwise(F.least(points, F.lit(4.0)))


def task_description_score(name: Column) -> Column:
    """0 under 5 bytes, 0.2 under 15, else 0.2 for each of: being there, a verb, something specific, over 40 bytes, over 80."""
    b = strip(F.coalesce(name, F.lit("")))
    n, low = F.octet_length(b), F.lower(b)
    points = reduce(lambda a, c: a + F.when(c, 0.2).otherwise(0.0), (_holds(low, TASK_VERBS), _holds(low, TASK_SPECIFICS), n > 40, n > 80), F.lit(0.2))
    return F.when(n < 5, F.lit(0.0)).when(n < 15, F.lit(0.2)).otherwise(snap(clamp(points, 0.0, 1.0), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))


def classify(text: Column, patterns: tuple[tuple[str, str], ...], default: str | None = None) -> Column:
    """The name of the first pattern found, case-insensitive."""
    return reduce(lambda c, p: c.when(text.rlike(f"(?i){p[1]}"), p[0]), patterns[1:], F.when(text.rlike(f"(?i){patterns[0][1]}"), patterns[0][0])).otherwise(F.lit(default).cast("string"))


def classified(text: Column, patterns: tuple[tuple[str, str], ...]) -> Column:
    """array<struct<kind, n>>: how often each pattern occurs, of those that do."""
    each = F.array(*[F.struct(F.lit(name).alias("kind"), F.regexp_count(text, F.lit(f"(?i){p}")).alias("n")) for name, p in patterns])
    return F.filter(each, lambda x: x["n"] > 0)


def title_tokens(title: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case ASCII words and numbers of two or more characters that are no stop words, in order; none for null."""
    words = F.transform(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stop))


def _of(words: Column, known: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, known)))


def is_fix_title(title: Column) -> Column:
    return F.coalesce(_of(title_tokens(title), FIX_WORDS), F.lit(False))


def action_tag(words: Column) -> Column:
    """modify if a word of title tokens says so, else create."""
    return F.when(_of(words, MODIFY_WORDS), "modify").otherwise("create")


def layer_tags(words: Column, stack: Column) -> Column:
    """array<string>: the layers that title tokens name, of the stack's."""
    each = [F.when((stack == name) & _of(words, known), layer) for name, layers in LAYER_WORDS.items() for layer, known in layers.items()]
    return F.array_sort(F.filter(F.array(*each), lambda x: x.isNotNull()))


def mask_statement(text: Column) -> Column:
    """Text blocks, string and character literals, then numbers other than 0 and 1, to placeholders; white space collapsed."""
    s = F.regexp_replace(text, r'(?s)""".*?"""', "_STR_")
    s = F.regexp_replace(F.regexp_replace(s, r'"(?:[^"\\]|\\.)*"', "_STR_"), r"'(?:[^'\\]|\\.)*'", "_CHR_")
    return collapse(F.regexp_replace(s, r"(?<![\w.])(?!(?:0|1)(?:\.0)?(?![\w.]))\d+(?:\.\d+)?(?![\w.])", "_NUM_"))


def cosmetic_form(line: Column) -> Column:
    """A line with strings, characters, numbers and names to placeholders: lines of equal form differ in looks only."""
    s = F.regexp_replace(F.regexp_replace(strip(line), r'"(?:[^"\\]|\\.)*"', '"_"'), r"'(?:[^'\\]|\\.)*'", "'_'")
    s = F.regexp_replace(F.regexp_replace(s, r"\b\d[\d_.]*[lLfFdD]?\b", "_N_"), r"\b[a-zA-Z_]\w*\b", "_ID_")
    return collapse(s)


def imports_form(lines: Column) -> Column:
    """Import lines, white space collapsed, each once, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(lines, collapse), lambda x: x != "")))


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a path glob: ** any segments, * one segment."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + ("\\" if glob[i] in r".^$+?{}[]|()\\" else "") + glob[i], i + 1
    return f"^{out}$"


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def embedding_input(title: Column, body: Column, additions: Column, deletions: Column) -> Column:
    """The four lines that a pull request's text model reads."""
    line = lambda name, v: F.concat(F.lit(f"{name}: "), F.coalesce(v.cast("string"), F.lit("")))
    return F.concat_ws("\n", line("title", title), line("body", body), line("additions", additions), line("deletions", deletions))


def strip_comments(source: Column) -> Column:
    """Without block and line comments; a cheap form that does not look into strings (the scanner of sources.code does)."""
    return F.regexp_replace(F.regexp_replace(source, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")


#: Lines folded into one array at a time; arrays of chunks are joined once, so no line is copied over and over.
CHUNK = 256


def code_lines(lines: Column, path: Column) -> Column:
    """array<struct<i, line>> of the lines, from 0, that are neither blank nor comment, trimmed: // and /* */ in .java files, <!-- --> in .xml files. A comment left open goes on over the lines that follow."""
    kind = F.lower(F.substring_index(path, ".", -1))
    java, xml = kind == "java", kind == "xml"
    none = F.expr("cast(array() as array<struct<i:int,line:string>>)")
    def step(acc: Column, line: Column) -> Column:
        closes = (java & line.endswith("*/")) | (xml & line.endswith("-->"))
        opens = (java & line.startswith("/*")) | (xml & line.startswith("<!--"))
        comment = acc["open"] | opens | (java & (line.startswith("//") | line.startswith("*")))
        still = F.when(line == "", acc["open"]).otherwise((acc["open"] | opens) & ~closes)
        kept = F.concat(acc["out"], F.array(F.struct(acc["i"].alias("i"), line.alias("line"))))
        return F.struct((acc["i"] + 1).alias("i"), F.coalesce(still, F.lit(False)).alias("open"), F.when((line == "") | F.coalesce(comment, F.lit(False)), acc["out"]).otherwise(kept).alias("out"))

    def take(acc: Column, chunk: Column) -> Column:
        begin = F.struct(acc["i"].alias("i"), acc["open"].alias("open"), none.alias("out"))
        # Folded once, in a list of one.
        done = F.array(F.aggregate(chunk, begin, step))
        return F.transform(done, lambda v: F.struct(v["i"].alias("i"), v["open"].alias("open"), F.concat(acc["outs"], F.array(v["out"])).alias("outs")))[0]

    known = F.coalesce(lines, F.expr("cast(array() as array<string>)"))
    # A chunk's lines are trimmed before they are folded: in the fold a line would be trimmed wherever a condition names it.
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(known) / CHUNK).cast("int")), lambda k: F.transform(F.slice(known, k * CHUNK + 1, F.lit(CHUNK)), strip))
    first = F.struct(F.lit(0).alias("i"), F.lit(False).alias("open"), F.expr("cast(array() as array<array<struct<i:int,line:string>>>)").alias("outs"))
    return F.aggregate(chunks, first, take, lambda acc: F.flatten(acc["outs"]))


def finding_id(tool: Column, rule: Column, path: Column, line: Column, message: Column) -> Column:
    """SHA-1 of the parts joined by bars; nulls count as empty and 120 characters of the message count."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (tool, rule, path, line, F.left(message, F.lit(120)))]
    return F.sha1(F.array_join(F.array(*parts), "|"))


def append_json(existing: Column, kind: Column, detail: Column, most: int = 20) -> Column:
    """A JSON array of {kind, detail} with one more at the end and the oldest beyond ``most`` gone; what is no such array counts as empty."""
    shape = "array<struct<kind:string,detail:string>>"
    old = F.coalesce(F.from_json(existing, shape), F.array().cast(shape))
    new = F.concat(old, F.array(F.struct(kind.alias("kind"), detail.alias("detail"))))
    return F.to_json(F.slice(new, F.greatest(F.size(new) - most + 1, F.lit(1)), F.lit(most)))


def spread_json(early: Column, mid: Column, late: Column, cramming: Column) -> Column:
    """The counts of a sprint's thirds and its end as JSON, keys in this order."""
    return F.format_string('{"early": %d, "mid": %d, "late": %d, "cramming": %d}', early, mid, late, cramming)


def coordinates(build: Column) -> Column:
    """Distinct group:artifact pairs of quoted dependency strings, in order of name."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(build, F.lit(r"""["']([A-Za-z][\w.-]*:[\w.-]+)(?::[^"']*)?["']"""), F.lit(1))))
