"""Column functions over text, all JVM-side.

White space means Unicode white space everywhere: patterns carry ``(?U)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def flat(c: Column) -> Column:
    """On one line: runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fallback(*options: Column) -> Column:
    """The first option that is not blank, else the last one."""
    *first, last = options
    return F.coalesce(*(F.when(~is_blank(o), o) for o in first), last)


def content_key(c: Column) -> Column:
    """Key of a text in the translation memory: sha256 of the stripped text."""
    return F.sha2(strip(c), 256)


# What a slug and a file name may not hold, the longest file name, and the names of nothing.
SLUG_GAPS, FILE_GAPS, FILE_LENGTH, NO_SLUG, NO_FILE = r"[^\w-]+", r'[\\/:*?"<>|\r\n\t]+', 120, "book", "translated"


def slugify(c: Column) -> Column:
    """Runs of other characters than word characters and hyphens become one underscore; never empty."""
    s = F.regexp_replace(F.regexp_replace(c, "(?U)" + SLUG_GAPS, "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(NO_SLUG))


def file_name(c: Column, default: str = NO_FILE) -> Column:
    """A name that every file system takes, of at most 120 characters."""
    s = F.regexp_replace(strip(F.regexp_replace(F.coalesce(c, F.lit("")), FILE_GAPS, " ")), r"^\.+|\.+$", "")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(s, r"(?U)\s+", " "), 1, FILE_LENGTH), F.lit("")), F.lit(default))


def html_escape(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


# The marks that end a sentence.
SENTENCE_ENDS = "。．.!！？?…\n"


def sentences(c: Column) -> Column:
    """The text cut after each sentence end, which stays with what it ends; no empty parts."""
    return F.filter(F.split(c, f"(?<=[{SENTENCE_ENDS}])", -1), lambda s: F.length(s) > 0)


# Chapter markers of plain text, Markdown and Japanese.
MARKDOWN_HEADING = r"^(#{1,3})(?U)\s+(.*\S)\s*$"
JAPANESE_HEADING = r"^\s*(?:第[0-9０-９一二三四五六七八九十百千]+[章話節節回部巻]|序章|終章|序幕|終幕|プロローグ|エピローグ|あとがき|まえがき)"


def heading(line: Column) -> Column:
    """struct(title, level) of a line that opens a chapter, else null."""
    marks = F.regexp_extract(line, MARKDOWN_HEADING, 1)
    return F.when(F.length(marks) > 0, F.struct(strip(F.regexp_extract(line, MARKDOWN_HEADING, 2)).alias("title"), F.length(marks).alias("level"))).when(
        line.rlike("(?U)" + JAPANESE_HEADING), F.struct(strip(line).alias("title"), F.lit(1).alias("level"))
    )


# Names of languages and their codes.
LANGUAGE_CODES = {
    "japanese": "ja", "日语": "ja", "日文": "ja", "jp": "ja", "jpn": "ja",
    "english": "en", "英语": "en", "英文": "en", "eng": "en",
    "russian": "ru", "俄语": "ru", "俄文": "ru", "rus": "ru",
    "chinese": "zh", "中文": "zh", "汉语": "zh", "zh-cn": "zh", "zho": "zh",
    "korean": "ko", "韩语": "ko", "韩文": "ko", "kor": "ko",
    "french": "fr", "法语": "fr", "法文": "fr",
    "german": "de", "德语": "de", "德文": "de",
    "spanish": "es", "西班牙语": "es", "西班牙文": "es",
    "italian": "it", "意大利语": "it", "意大利文": "it",
    "portuguese": "pt", "葡萄牙语": "pt", "葡萄牙文": "pt",
}
# What stands for no language.
UNKNOWN_LANGUAGES = ("", "auto", "unknown", "und", "uncertain", "mixed", "多语言", "未知")
# Display names of languages.
LANGUAGE_LABELS = {
    "ja": "日文", "en": "英文", "zh": "中文", "ru": "俄文", "ko": "韩文", "fr": "法文", "de": "德文", "es": "西班牙文", "it": "意大利文", "pt": "葡萄牙文",
}


def _mapping(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def language_code(c: Column) -> Column:
    """Two-letter code of a language name or alias; empty if unknown."""
    low = F.lower(strip(F.coalesce(c, F.lit(""))))
    prefix = F.substring(low, 1, 2)
    return F.when(low.isin(*UNKNOWN_LANGUAGES), "").otherwise(F.coalesce(F.try_element_at(_mapping(LANGUAGE_CODES), low), F.when(prefix.rlike(r"^\p{L}+$"), prefix).otherwise("")))


def language_label(code: Column) -> Column:
    """Display name of a language code."""
    other = F.when(F.length(code) > 0, F.concat(code, F.lit("文"))).otherwise(F.lit("原文"))
    return F.coalesce(F.try_element_at(_mapping(LANGUAGE_LABELS), code), other, F.lit("原文"))


#: What a translator is told about forms of address, by strategy, and about texts in a language.
HONORIFICS = {
    "keep": "Show the relation and the tone that a form of address carries; once chosen, keep its rendering through the book.",
    "normalize": "Render each form of address in one way everywhere.",
    "drop": "Leave forms of address out where neither meaning nor relation suffers.",
}
GUIDANCE = {
    "ja": "Forms of address: $rule Tell pronouns and voice from first persons and roles. Put sound words into natural words. Chinese characters do not mean what they look like.",
    "en": "Treat Mr, Ms and Sir as the target language would. Tell pronouns from names and context. Break long sentences and passives up. Use known renderings of names.",
}
TERM_GUIDANCE = {"ja": "Give the reading in kana; tell gender from voice and first person.", "en": "The reading may stay empty; tell gender from names and context."}
OTHER_GUIDANCE, OTHER_TERM_GUIDANCE = "Be true to the meaning and natural in the target language.", "The reading may stay empty; tell gender from context."
OTHER_HONORIFIC = "Keep the tone of forms of address, the same through the book."


def honorific_rule(strategy: Column) -> Column:
    """What is to be done with forms of address; a default for unknown strategies."""
    return F.coalesce(F.try_element_at(_mapping(HONORIFICS), strategy), F.lit(OTHER_HONORIFIC))


def translation_guidance(code: Column, strategy: Column) -> Column:
    """What a translator from a language is told, with the rule for forms of address where it has them."""
    own = F.replace(F.try_element_at(_mapping(GUIDANCE), code), F.lit("$rule"), honorific_rule(strategy))
    return F.coalesce(own, F.lit(OTHER_GUIDANCE))


def term_guidance(code: Column) -> Column:
    """What is to be noted of terms of a language."""
    return F.coalesce(F.try_element_at(_mapping(TERM_GUIDANCE), code), F.lit(OTHER_TERM_GUIDANCE))


def epub_language(c: Column) -> Column:
    """Language tag for book metadata; Chinese and missing ones become zh-Hans."""
    low = F.lower(F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("_"), F.lit("-")))
    return F.when(low.isin("", "zh", "zh-cn", "zh-hans", "cn"), "zh-Hans").otherwise(c)


def chapter_label(title: Column, chapter: Column) -> Column:
    """The title, or the ordinal of the chapter, counted from 1."""
    return fallback(title, F.format_string("第 %d 章", chapter + 1))


def batch_key(start: Column, count: Column) -> Column:
    return F.concat_ws(":", start, count)


def body_of(html: Column) -> Column:
    """What stands between the body tags, or the whole text without them."""
    inner = F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1)
    return F.when(html.rlike(r"(?is)<body[^>]*>.*?</body>"), inner).otherwise(html)


def head_of(html: Column) -> Column:
    """What stands between the head tags but for titles and declarations of the encoding, stripped of white
    space; empty without them."""
    inner = F.regexp_extract(html, r"(?is)<head[^>]*>(.*?)</head>", 1)
    bare = F.regexp_replace(F.regexp_replace(inner, r"(?is)<title[^>]*>.*?</title>", ""), r"(?i)<meta[^>]*charset[^>]*/?>", "")
    return strip(bare)


def one_page(pages: Column, title: Column) -> Column:
    """The pages of an array as one page: the head of the first, the bodies of all."""
    top = F.concat(F.lit('<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>'), html_escape(title), F.lit("</title>\n"), head_of(F.get(pages, F.lit(0))), F.lit("\n</head>\n<body>\n"))
    return F.concat(top, F.array_join(F.transform(pages, body_of), ""), F.lit("\n</body>\n</html>"))


# Style values, an attribute and a class that ask for vertical writing.
VERTICAL_MODES, RIGHT_TO_LEFT, VERTICAL_CLASS = ("vertical-rl", "vertical-lr", "tb-rl"), ("page-progression-direction", "rtl"), "vrtl"


def looks_vertical(markup: Column) -> Column:
    """Whether markup or style asks for vertical writing: by a writing mode, with or without a prefix, by the
    direction of its pages, or by a class."""
    low = F.lower(markup)
    modes = F.transform(F.regexp_extract_all(low, F.lit(r"writing-mode\s*:\s*([a-z-]+)"), F.lit(1)), lambda m: m.isin(*VERTICAL_MODES))
    name, value = RIGHT_TO_LEFT
    turned = low.rlike(rf"{name}\s*=\s*[\"']{value}[\"']")
    classes = F.flatten(F.transform(F.regexp_extract_all(low, F.lit(r"\bclass\s*=\s*[\"']([^\"']*)"), F.lit(1)), lambda c: F.split(c, r"[^\w]+")))
    return F.coalesce(F.exists(modes, lambda m: m) | turned | F.array_contains(classes, VERTICAL_CLASS), F.lit(None).cast("boolean"))
