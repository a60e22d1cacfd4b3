"""Declarative text-rule audit.

Texts are split into lines (``posexplode`` of the newline split); a blank
line starts a new stanza. Every check is an array/regex expression per
line, aggregated per stanza and per text with boolean aggregates. Word
lists are literal arrays inside the expressions (no join, no shuffle).
Rules that need phonetics or a language dictionary (1 rhyme, 12
limerick, 14 foreign word) are not checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.core import r6
from tastemill.session import materialize

# ---- fixed values --------------------------------------------------------
RULES = [
    (1, "Rhyming Zig-Zag", "Every alternating line (or sentence) must rhyme; the others must not."),
    (2, "Double-Word Twist", "Each line must include exactly one repeated word (e.g., 'wind wind', 'glow glow')."),
    (3, "A Touch of Color", "In each stanza, use at least two words describing color (e.g., 'purple', 'scarlet', 'silver')."),
    (4, "Elemental Reference", "Include the name of a chemical element (like hydrogen, gold, neon) in every line."),
    (5, "Hidden Palindrome", "Slip a palindrome (e.g., 'racecar', 'kayak') into at least one line."),
    (6, "Show, Don’t Tell", "Avoid using the word 'feel'; instead, use imagery to imply emotion."),
    (7, "Animal Obsession", "Mention a different animal in each stanza."),
    (8, "Consonant Alliteration", "Every odd-numbered line should start with at least three alliterative consonants (e.g., 'Boldly bounding bees…')."),
    (9, "Answer Me!", "Every even-numbered line should end with a question mark."),
    (10, "No ‘E’ Allowed", "Write one entire stanza without using the letter 'e'."),
    (11, "Sound Effects", "Include a sound effect (like 'bang', 'whir', 'pop') in each stanza."),
    (12, "Mini Limerick", "One stanza in the middle of your poem must follow the AABBA limerick rhyme scheme."),
    (13, "Comparisons Rule", "Every stanza must have at least one simile (using 'like' or 'as')."),
    (14, "Use a Foreign Word", "Slip at least one non-English word into each stanza (e.g., 'c’est la vie', 'arrivederci')."),
    (15, "Breaking the Fourth Wall", "Address the reader directly in at least one line ('Dear reader, …')."),
    (16, "Cap It Off", "Write one line in ALL CAPS to emphasize something (only do this once)."),
    (17, "Seasonal Shuffle", "Every stanza must reference a different season (winter, spring, summer, autumn)."),
    (18, "Line Length Trick", "Each line must have at least one word of 10 or more letters (e.g., 'hyperbolic', 'translucent')."),
    (19, "Dance with Numbers", "Include at least one numerical value or fraction in each stanza (e.g., '42', '⅓', '6.28')."),
    (20, "Grand Finale", "End the poem with the word 'fin'."),
]
NOT_CHECKED = (1, 12, 14)
COLOURS = ["red", "orange", "yellow", "green", "blue", "purple", "violet", "indigo", "pink", "brown",
           "black", "white", "gray", "grey", "silver", "gold", "golden", "scarlet", "crimson", "azure",
           "amber", "ivory", "teal", "cyan", "magenta", "maroon", "beige", "cobalt", "emerald", "turquoise",
           "lavender", "bronze", "copper", "rust", "charcoal", "navy", "olive", "ochre"]
ELEMENTS = ["hydrogen", "helium", "lithium", "beryllium", "boron", "carbon", "nitrogen", "oxygen", "fluorine",
            "neon", "sodium", "magnesium", "aluminium", "aluminum", "silicon", "phosphorus", "sulfur", "sulphur",
            "chlorine", "argon", "potassium", "calcium", "scandium", "titanium", "vanadium", "chromium",
            "manganese", "iron", "cobalt", "nickel", "copper", "zinc", "gallium", "germanium", "arsenic",
            "selenium", "bromine", "krypton", "rubidium", "strontium", "yttrium", "zirconium", "niobium",
            "molybdenum", "technetium", "ruthenium", "rhodium", "palladium", "silver", "cadmium", "indium",
            "tin", "antimony", "tellurium", "iodine", "xenon", "caesium", "cesium", "barium", "lanthanum",
            "cerium", "praseodymium", "neodymium", "promethium", "samarium", "europium", "gadolinium",
            "terbium", "dysprosium", "holmium", "erbium", "thulium", "ytterbium", "lutetium", "hafnium",
            "tantalum", "tungsten", "rhenium", "osmium", "iridium", "platinum", "gold", "mercury", "thallium",
            "lead", "bismuth", "polonium", "astatine", "radon", "francium", "radium", "actinium", "thorium",
            "protactinium", "uranium", "neptunium", "plutonium", "americium", "curium", "berkelium",
            "californium", "einsteinium", "fermium", "mendelevium", "nobelium", "lawrencium",
            "rutherfordium", "dubnium", "seaborgium", "bohrium", "hassium", "meitnerium", "darmstadtium",
            "roentgenium", "copernicium", "nihonium", "flerovium", "moscovium", "livermorium", "tennessine",
            "oganesson"]
ANIMALS = ["ant", "bat", "bear", "bee", "bird", "cat", "cicada", "cow", "crow", "deer", "dog", "dolphin",
           "dove", "duck", "eagle", "elephant", "falcon", "fish", "fox", "frog", "goat", "goose", "hawk",
           "horse", "lion", "lizard", "mouse", "moth", "owl", "ox", "panther", "pig", "rabbit", "rat",
           "raven", "robin", "shark", "sheep", "snake", "sparrow", "spider", "squirrel", "swan", "tiger",
           "turtle", "whale", "wolf", "wren", "butterfly", "beetle", "hare", "heron", "lark", "mole",
           "otter", "salmon", "seal", "stag", "toad"]
SOUNDS = ["bang", "boom", "buzz", "click", "clang", "crash", "crack", "creak", "ding", "drip", "hiss",
          "hum", "hush", "knock", "murmur", "pop", "purr", "ring", "roar", "rumble", "screech", "sizzle",
          "slam", "snap", "splash", "swish", "thud", "thump", "tick", "tock", "twang", "whack", "whir",
          "whisper", "whoosh", "zap"]
SEASONS = ["winter", "spring", "summer", "autumn", "fall"]
SIMILE_WORDS = ["like", "as"]
FORBIDDEN = ["feel"]
LEXICONS = {"colour": COLOURS, "element": ELEMENTS, "animal": ANIMALS, "sound": SOUNDS, "season": SEASONS}
WORD_PATTERN = r"\p{L}+"
# --------------------------------------------------------------------------


def _arr(words: list[str]) -> str:
    return "array(" + ", ".join("'" + w + "'" for w in words) + ")"


def _count_in(col: str, words: list[str]) -> F.Column:
    return F.expr(f"size(filter({col}, w -> w IN {_arr(words)[5:]}))")     # a hash set, no scan of the list


def split_lines(texts: DataFrame) -> DataFrame:
    """(doc_id, author, pos, line, stanza, line_no, words) for non-blank lines.

    ``stanza`` counts blank lines before the line; ``line_no`` numbers the
    non-blank lines of a text from 1.
    """
    x = texts.select("doc_id", "author", F.posexplode(F.split(F.col("text"), "\n")).alias("pos", "line"))
    x = x.withColumn("blank", (F.trim("line") == "").cast("int"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("stanza", F.sum("blank").over(w)).filter(F.col("blank") == 0)
    x = x.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    return x.withColumn("words", F.regexp_extract_all(F.lower("line"), F.lit(WORD_PATTERN), 0)).drop("blank")


def line_checks(lines: DataFrame) -> DataFrame:
    """Per line: rules 2, 4, 6, 8, 9, 18 (8 and 9 only bind odd/even lines)."""
    repeats = F.expr("CASE WHEN size(words) < 2 THEN 0 ELSE size(filter(sequence(1, size(words) - 1), "
                     "i -> try_element_at(words, i) = try_element_at(words, i + 1))) END")
    first = [F.substring(F.try_element_at("words", F.lit(i)), 1, 1) for i in (1, 2, 3)]
    allit = ((F.size("words") >= 3) & (first[0] == first[1]) & (first[1] == first[2])
             & first[0].rlike("^[b-df-hj-np-tv-z]$"))
    odd = (F.col("line_no") % 2) == 1
    return lines.select(
        "doc_id", "author", "stanza", "line_no", "line", "words",
        (repeats == 1).alias("r2"),
        (_count_in("words", ELEMENTS) > 0).alias("r4"),
        (_count_in("words", FORBIDDEN) == 0).alias("r6"),
        F.when(odd, F.coalesce(allit, F.lit(False))).otherwise(F.lit(True)).alias("r8"),
        F.when(~odd, F.rtrim("line").endswith("?")).otherwise(F.lit(True)).alias("r9"),
        (F.expr("size(filter(words, w -> length(w) >= 10))") > 0).alias("r18"),
        _count_in("words", COLOURS).alias("n_colour"),
        _count_in("words", ANIMALS).alias("n_animal"),
        _count_in("words", SOUNDS).alias("n_sound"),
        _count_in("words", SEASONS).alias("n_season"),
        (_count_in("words", SIMILE_WORDS) > 0).alias("simile"),
        F.col("line").rlike("[eE]").alias("has_e"),
        F.col("line").rlike(r"\p{N}").alias("has_num"),
        (F.col("line").rlike(r"\p{L}") & ~F.col("line").rlike(r"\p{Ll}")).alias("all_caps"),
        (F.expr("size(filter(words, w -> length(w) >= 3 AND reverse(w) = w))") > 0).alias("palin"),
        F.lower("line").contains("dear reader").alias("dear"),
    )


def stanza_checks(lc: DataFrame) -> DataFrame:
    """Per stanza aggregates of the line flags."""
    return lc.groupBy("doc_id", "stanza").agg(
        F.sum("n_colour").alias("n_colour"), F.sum("n_animal").alias("n_animal"),
        F.sum("n_sound").alias("n_sound"), F.sum("n_season").alias("n_season"),
        F.bool_or("simile").alias("simile"), F.bool_or("has_e").alias("has_e"),
        F.bool_or("has_num").alias("has_num"))


def _distinct_hits(lc: DataFrame, hits: str, name: str) -> DataFrame:
    return lc.select("doc_id", F.explode(hits).alias("w")).groupBy("doc_id").agg(F.countDistinct("w").alias(name))


def line_flags(texts: DataFrame) -> DataFrame:
    """The checks of every line, written once without its text: lines are
    split and searched one time for all that is added up from them."""
    lc = line_checks(split_lines(texts))
    fin = F.coalesce(F.try_element_at("words", F.lit(-1)) == F.lit("fin"), F.lit(False))
    lc = lc.withColumns({"animals": F.expr(f"array_intersect(words, {_arr(ANIMALS)})"), "seasons": F.expr(f"array_intersect(words, {_arr(SEASONS)})"), "fin": fin})
    return materialize(lc.drop("line", "words"), "line-flags")


SOMEWHERE = (5, 10, 15, 16, 20)      # rules that ask for something to occur in the text


def rule_results(texts: DataFrame) -> DataFrame:
    """Wide table: one row per text, one boolean column ``r<id>`` per
    checked rule. A text without lines (null or blank) keeps its row: what
    every line or stanza must do holds, what must occur somewhere doesn't."""
    lc = line_flags(texts)
    per_line = lc.groupBy("doc_id", "author").agg(
        F.bool_and("r2").alias("r2"), F.bool_and("r4").alias("r4"), F.bool_and("r6").alias("r6"),
        F.bool_and("r8").alias("r8"), F.bool_and("r9").alias("r9"), F.bool_and("r18").alias("r18"),
        F.bool_or("palin").alias("r5"), F.bool_or("dear").alias("r15"),
        (F.count_if("all_caps") == 1).alias("r16"),
        F.max_by("fin", "line_no").alias("r20"))
    st = stanza_checks(lc).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_stanzas"),
        F.bool_and(F.col("n_colour") >= 2).alias("r3"),
        F.bool_and(F.col("n_animal") >= 1).alias("_a"),
        F.bool_or(~F.col("has_e")).alias("r10"),
        F.bool_and(F.col("n_sound") >= 1).alias("r11"),
        F.bool_and("simile").alias("r13"),
        F.bool_and(F.col("n_season") >= 1).alias("_s"),
        F.bool_and("has_num").alias("r19"))
    da = _distinct_hits(lc, "animals", "n_animals")
    ds = _distinct_hits(lc, "seasons", "n_seasons")
    j = (per_line.join(st, "doc_id").join(da, "doc_id", "left").join(ds, "doc_id", "left")
         .withColumn("r7", F.col("_a") & (F.coalesce("n_animals", F.lit(0)) >= F.col("n_stanzas")))
         .withColumn("r17", F.col("_s") & (F.coalesce("n_seasons", F.lit(0)) >= F.col("n_stanzas"))))
    checked = [r for r, _, _ in RULES if r not in NOT_CHECKED]
    whole = texts.select("doc_id", "author").distinct().join(j.drop("author"), "doc_id", "left")
    return whole.select("doc_id", "author", F.coalesce("n_stanzas", F.lit(0)).cast("bigint").alias("n_stanzas"),
                        *[F.coalesce(f"r{r}", F.lit(r not in SOMEWHERE)).alias(f"r{r}") for r in checked])


def broken_rules(results: DataFrame) -> DataFrame:
    """(doc_id, author, broken array<int>, n_broken): failed checked rules."""
    checked = [r for r, _, _ in RULES if r not in NOT_CHECKED]
    arr = F.array(*[F.when(~F.col(f"r{r}"), F.lit(r)) for r in checked])
    return results.select("doc_id", "author", F.filter(arr, lambda x: x.isNotNull()).alias("broken")) \
        .withColumn("n_broken", F.size("broken"))


def author_league(broken: DataFrame) -> DataFrame:
    """Per author: texts, mean broken rules, rank (fewest broken first)."""
    a = broken.groupBy("author").agg(F.count(F.lit(1)).alias("n_texts"),
                                     F.avg("n_broken").alias("avg_broken"))
    return a.withColumn("rank", F.rank().over(Window.orderBy(r6("avg_broken"))))
