"""Text features as Column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.scalar import safe_div

# Flag patterns, matched against lower-cased text. The stems before \b match no longer word, as they must.
GREETING = r"^(hi|hello|hey|dear|good\s+(morning|afternoon|evening)|greetings)\b"
FLAGS = {
    "has_thanks": r"\b(thank|thanks|grateful|appreciate)\b",
    "has_apology": r"\b(sorry|apologi[sz]e|excuse me|pardon)\b",
    "has_frustration": r"\b(confused|frustrat|don'?t understand|why was my|what happened to)\b",
    "has_self_intro": r"\b(i'?m new|new to|first time|beginner|newbie|newcomer|just started)\b",
    "has_urgency": r"\b(urgent|asap|please help|need help|help me)\b",
}
TOPICS = {
    "mentions_deletion": r"\b(delet|speedy|[ac]fd|csd|proposed deletion|prod)\b",
    "mentions_revert": r"\b(revert|undone|rolled? back|undo)\b",
    "mentions_notability": r"\b(notab|GNG|significant coverage|reliable sources)\b",
    "mentions_copyright": r"\b(copyright|copyvio|plagiari|fair use)\b",
    "mentions_draft": r"\b(draft|sandbox|userspace)\b",
    "mentions_protection": r"\b(protect|semi.?protect|autoconfirm|edit.?request)\b",
    "mentions_conflict": r"\b(dispute|edit.?war|consensus|3rr|revert.?war)\b",
}
TOKENS = {"n_policy": "[POLICY]", "n_help": "[HELP_PAGE]", "n_wikilink": "[WIKILINK]", "n_link": "[LINK]", "n_draft": "[DRAFT]"}
LIST_LINE = r"(?m)^\s*[\*\-\#\d]"

_SPACE = r"(?U)\s+"


def norm_user(name: Column) -> Column:
    """Null becomes empty; underscores and no-break spaces become spaces; ends are trimmed."""
    return F.trim(F.translate(F.coalesce(name, F.lit("")), "_ ", "  "))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Split at white space of any kind, without empty parts; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda x: x != "")


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a literal string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def sentence_count(text: Column) -> Column:
    """Pieces between runs of . ! ?, less one, but one at least; blank texts have none."""
    trimmed = strip(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", 0).otherwise(F.greatest(F.lit(1), F.size(F.split(trimmed, "[.!?]+", -1)) - 1)).cast("long")


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def text_parts(text: Column) -> Column:
    """What text_features() uses again and again: the text, its words, its lower case and its number of sentences, as one struct."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(t.alias("t"), words(t).alias("w"), F.lower(t).alias("lower"), sentence_count(t).alias("sentences"))


def text_features(text: Column, prefix: str, parts: Column | None = None) -> dict[str, Column]:
    """The thirty text features of a message; empty and null texts have zeros. parts: text_parts() of it, where that is a column already."""
    parts = text_parts(text) if parts is None else parts
    t, w, lower, sentences = (parts.getField(k) for k in ("t", "w", "lower", "sentences"))
    n = F.size(w)
    out = {
        "words": n.cast("long"),
        "chars": F.length(t).cast("long"),
        "sentences": sentences,
        "avg_word_len": safe_div(F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)), n),
        "type_token_ratio": safe_div(F.size(F.array_distinct(F.transform(w, F.lower))), n),
        "avg_sentence_len": safe_div(n, F.greatest(sentences, F.lit(1))),
        "is_single_sentence": _flag((sentences <= 1) & (t != "")),
        "n_paragraphs": F.when(t == "", 0).otherwise(count_of(t, "\n\n") + 1).cast("long"),
        "n_question_marks": count_of(t, "?"),
        "n_exclamation": count_of(t, "!"),
        "has_question_mark": _flag(t.contains("?")),
        "has_greeting": _flag(lower.rlike("(?U)" + GREETING)),
    }
    out |= {k: _flag(lower.rlike("(?U)" + p)) for k, p in FLAGS.items()}
    out["has_list"] = _flag(t.rlike(LIST_LINE.replace("(?m)", "(?mU)")))
    out |= {k: count_of(t, p) for k, p in TOKENS.items()}
    out |= {k: _flag(lower.rlike("(?U)" + p)) for k, p in TOPICS.items()}
    return {f"{prefix}_{k}": c for k, c in out.items()}


def with_text_features(rows: DataFrame, text: str, prefix: str) -> DataFrame:
    """rows with the features of a column; words and lower case are made once a row, as a generator is not merged into what uses it."""
    name = f"__{prefix}_parts"
    made = rows.withColumn(name, F.explode(F.array(text_parts(F.col(text)))))
    return made.select(*rows.columns, *[c.alias(k) for k, c in text_features(F.col(text), prefix, F.col(name)).items()])


def is_english(text: Column, share: float = 0.8) -> Column:
    """Whether Latin letters A-Z make up this share of all letters; true for texts of under three characters or without letters."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return (F.length(t) < 3) | (letters == 0) | (F.length(F.regexp_replace(t, "[^A-Za-z]", "")) >= share * letters)


# Pronouns by kind.
PRONOUNS = {
    "you": ["you", "your", "yours", "yourself", "yourselves"],
    "i": ["i", "me", "my", "mine", "myself"],
    "we": ["we", "us", "our", "ours", "ourselves"],
}


def pronoun_counts(text: Column, pronouns: dict[str, list[str]] | None = None) -> dict[str, Column]:
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b[a-z']+\b"), F.lit(0))
    among = lambda names: F.size(F.filter(found, lambda x: x.isin(*names))).cast("long")
    return {f"n_{k}": among(v) for k, v in (pronouns or PRONOUNS).items()}


def pronoun_rates(text: Column, pronouns: dict[str, list[str]] | None = None) -> dict[str, Column]:
    """pronoun_counts() and, as rate_k, each over the number of words (one at least)."""
    counts, n = pronoun_counts(text, pronouns), F.greatest(F.size(words(text)), F.lit(1))
    return counts | {f"rate_{k[2:]}": c / n for k, c in counts.items()}


def syllables(word: Column) -> Column:
    """Vowel groups of a word, less a final e; one at least. Words of one or two letters have one."""
    w = strip(F.lower(word))
    n = F.regexp_count(w, F.lit("[aeiouy]+"))
    n = F.when(w.endswith("e") & (n > 1), n - 1).otherwise(n)
    return F.when(F.length(w) <= 2, 1).otherwise(F.greatest(n, F.lit(1))).cast("long")


def readability(text: Column) -> dict[str, Column]:
    """Flesch-Kincaid grade and syllables per word; zeros for texts without words."""
    t = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(t, F.lit("[a-zA-Z]+"), F.lit(0))
    n = F.size(found)
    total = F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + syllables(x))
    pieces = F.size(F.filter(F.split(t, "[.!?]+", -1), lambda x: strip(x) != ""))
    return {
        "fk_grade": F.when(n > 0, 0.39 * n / F.greatest(pieces, F.lit(1)) + 11.8 * total / n - 15.59).otherwise(0.0),
        "avg_syllables": F.when(n > 0, total / n).otherwise(0.0),
    }


def step_count(text: Column) -> dict[str, Column]:
    """The larger number of numbered lines and of "step N" mentions, and whether there are two."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.regexp_count(t, F.lit(r"(?:^|\n)\s*\d+[.\)]\s")), F.regexp_count(t, F.lit(r"(?i)\bstep\s+\d+")))
    return {"n_steps": n.cast("long"), "has_steps": (n >= 2).cast("int")}


# Fixed value: the time of a signature.
SIGNATURE_TIME = r"\d{2}:\d{2},\s*\d{1,2}\s+\w+\s+\d{4}\s*\(UTC\)"


def wiki_features(raw: Column) -> dict[str, Column]:
    """Ten markup measures; all but the first two of the text before its first signature time. Null and empty texts have zeros."""
    t = F.coalesce(raw, F.lit(""))
    body = strip(F.regexp_replace(strip(F.split(t, SIGNATURE_TIME, 2)[0]), r"[—–~\-]{2,}\s*$", ""))
    return {
        "has_signature": _flag(t.rlike(SIGNATURE_TIME)),
        "has_unsigned": _flag(t.rlike(r"(?i)\{\{unsigned|Preceding unsigned comment added by")),
        "link_count": F.regexp_count(body, F.lit(r"\[\[.+?\]\]")).cast("long"),
        "template_count": F.regexp_count(body, F.lit(r"\{\{.+?\}\}")).cast("long"),
        "has_url": _flag(F.lower(body).contains("http")),
        "mentions_wp": F.regexp_count(body, F.lit("(?i)WP:")).cast("long"),
        "mentions_help": F.regexp_count(body, F.lit("(?i)Help:")).cast("long"),
        "is_indented": _flag(body.startswith(":") | body.startswith("*")),
        "body_char_len": F.length(body).cast("long"),
        "body_word_count": F.size(words(body)).cast("long"),
    }


# Markers of politeness, searched in lower-cased, trimmed text; ^ anchors at its start.
POLITENESS = {
    "please": r"please",
    "please_start": r"^please",
    "hedge_word": r"\b(kind of|sort of|maybe|perhaps|possibly|probably|somewhat|rather)\b",
    "indirect_btw": r"\b(by the way|btw|incidentally)\b",
    "hedges_think": r"\b(i think|i believe|i suppose|i guess|i mean|it seems)\b",
    "factuality": r"\b(actually|in fact|just|really)\b",
    "deference": r"\b(great|nice|good|excellent|interesting|wonderful)\b",
    "gratitude": r"\b(thank|thanks|grateful|appreciate)\b",
    "apologizing": r"\b(sorry|apologi[sz]e|excuse me|pardon)\b",
    "1st_person_pl": r"\b(we|us|our|ours|ourselves)\b",
    "1st_person": r"\b(i|my|me|mine|myself)\b",
    "1st_person_start": r"^(i|my)\b",
    "2nd_person": r"\b(you|your|yours|yourself)\b",
    "2nd_person_start": r"^(you|your)\b",
    "indirect_greeting": r"^(hi|hello|hey|dear|greetings)\b",
    "direct_question": r"\?",
    "direct_start": r"^(can|could|would|will|do|does|did|is|are|was|were|have|has|had|should)\b",
    "has_positive": r"\b(good|great|nice|love|wonderful|excellent|amazing|awesome|happy|glad)\b",
    "has_negative": r"\b(bad|terrible|awful|horrible|hate|worst|ugly|stupid|annoying|frustrated|angry)\b",
    "subjunctive": r"\b(could|would|should|might|may)\b",
    "indicative": r"\b(will|going to|have to|need to|must|shall)\b",
}


def politeness(text: Column, prefix: str = "polite") -> dict[str, Column]:
    """One flag for each marker; empty and null texts have zeros."""
    lower = strip(F.lower(F.coalesce(text, F.lit(""))))
    return {f"{prefix}_{k}": _flag(lower.rlike("(?U)" + p)) for k, p in POLITENESS.items()}


def resource_count(text: Column) -> Column:
    """Article, policy, help and outside links together."""
    t = F.coalesce(text, F.lit(""))
    return sum((count_of(t, TOKENS[k]) for k in ("n_wikilink", "n_policy", "n_help", "n_link")), F.lit(0)).cast("long")


def kappa_level(k: Column) -> Column:
    """Names of the bands of agreement; each lower bound belongs to its band."""
    return F.when(k >= 0.81, "Almost perfect").when(k >= 0.61, "Substantial").when(k >= 0.41, "Moderate").when(k >= 0.21, "Fair").otherwise("Slight")


def to_yn(v: Column) -> Column:
    return F.when(F.upper(F.trim(v)) == "Y", "Y").otherwise("N")
