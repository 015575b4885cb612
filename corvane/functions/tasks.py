"""What a task text asks for: intent, and exact rename pairs in English and Russian.

A text is split into marks, words and arrows. A command is an imperative verb at
the beginning of a sentence, or "change the name of"; the words after it give
the pair: a name, a word that says "to" in the same language, a name.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.ship import ship

# The words of a command, by language, and how far apart they may stand, in characters.
VERBS = {"rename": "en", "переименуй": "ru", "переименуйте": "ru"}
PLEASE = {"please": "en", "пожалуйста": "ru"}
NAMED = ("name", "identifier")
LINKS = {"en": ("to", "as", "->", "→"), "ru": ("в", "на", "->", "→")}
NEGATIONS = (("do", "not"), ("don't",), ("never",), ("avoid",), ("without",))
NOUNS = ("rename", "renaming")
RUSSIAN_NEGATIONS, RUSSIAN_STEM = ("не", "без"), "переимен"
GOAL_WITHIN, PAIR_WITHIN, NAME_WITHIN, NEGATED_WITHIN = 180, 140, 40, 80

TOKEN = re.compile(r"->|→|[\w$]+(?:['’][\w]+)*|[^\s]")
NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
QUOTES = "`'\""


class Token(NamedTuple):
    word: str
    low: str
    start: int
    end: int


class Command(NamedTuple):
    language: str
    #: the first token after the command's words
    after: int
    #: where those words end
    end: int
    #: whether it says "change the name" rather than "rename"
    by_name: bool


def normalized(text: str | None) -> str:
    return " ".join(unicodedata.normalize("NFKC", text or "").split())


def tokens_of(flat: str) -> list[Token]:
    return [Token(m[0], m[0].lower(), m.start(), m.end()) for m in TOKEN.finditer(flat)]


def commands(words: list[Token]) -> Iterator[Command]:
    for i, t in enumerate(words):
        if t.low in VERBS:
            at = i - 1
            if VERBS[t.low] == "ru" and at > 0 and words[at].word == ",":
                at -= 1
            if at >= 0 and PLEASE.get(words[at].low) == VERBS[t.low]:
                at -= 1
            else:
                at = i - 1
            if at < 0 or words[at].word in ".!?":
                yield Command(VERBS[t.low], i + 1, t.end, False)
        elif t.low == "change":
            at = i + 1
            if at < len(words) and words[at].low == "the":
                at += 1
            if at < len(words) and words[at].low in NAMED:
                yield Command("en", at + 1, words[at].end, True)


def ruled_out(words: list[Token]) -> bool:
    """Whether the text forbids a rename."""
    for i, t in enumerate(words):
        if t.low in RUSSIAN_NEGATIONS and i + 1 < len(words) and words[i + 1].low.startswith(RUSSIAN_STEM):
            return True
        for phrase in NEGATIONS:
            if tuple(x.low for x in words[i : i + len(phrase)]) == phrase:
                end = words[i + len(phrase) - 1].end
                if any(x.low in NOUNS and x.start - end <= NEGATED_WITHIN for x in words[i + len(phrase) :]):
                    return True
    return False


def names_goal(words: list[Token], c: Command) -> bool:
    """Whether a word that says "to" follows the command, not right at once."""
    return any(t.low in LINKS[c.language] and 1 < t.start - c.end <= GOAL_WITHIN for t in words[c.after + 1 :])


def pair_after(words: list[Token], c: Command) -> tuple[str, str] | None:
    """The first name, link and name after a command; quotes around names do not count."""
    rest = [t for t in words[c.after :] if t.word not in QUOTES]
    if c.by_name:
        if not rest or rest[0].low != "of":
            return None
        rest = rest[1:]
    for i, t in enumerate(rest):
        if t.start - c.end > PAIR_WITHIN or (c.by_name and i):
            return None
        if not NAME.fullmatch(t.word):
            continue
        link = i + 1
        if c.by_name:
            while link < len(rest) and rest[link].low not in LINKS["en"] and rest[link].start - t.end <= NAME_WITHIN:
                link += 1
        elif c.language == "ru" and link < len(rest) and rest[link].word in ":,":
            link += 1
        if link + 1 < len(rest) and rest[link].low in LINKS[c.language] and NAME.fullmatch(rest[link + 1].word):
            return t.word, rest[link + 1].word
    return None


def rename_action(text: str | None) -> tuple[str, str | None, str | None, str]:
    """(status, old name, new name, reason) of one text."""
    words = tokens_of(normalized(text))
    if not words:
        return "unresolved", None, None, "task_action_text_empty"
    if ruled_out(words):
        return "unresolved", None, None, "task_action_negative_rename"
    pairs = {p for c in commands(words) if (p := pair_after(words, c)) and p[0] != p[1]}
    if len(pairs) != 1:
        return "unresolved", None, None, "task_action_multiple_rename_pairs" if pairs else "task_action_not_exact"
    return "exact", *pairs.pop(), "exact_rename_pair"


def intent_of(text: str | None) -> str:
    """rename_symbol, generic_edit or unknown: a rename needs a new name; an empty task is unknown."""
    words = tokens_of(normalized(text))
    asked = list(commands(words))
    if any(names_goal(words, c) for c in asked):
        return "rename_symbol"
    return "unknown" if not words or (asked and not ruled_out(words)) else "generic_edit"


def rename_actions(tasks: DataFrame) -> DataFrame:
    """(id, text) -> id, status, old_name, new_name, reason. Unicode normalisation is not a Spark function, so texts go through Python in batches."""
    import pandas as pd

    ship(tasks.sparkSession)

    def run(batches):
        for pdf in batches:
            rows = [rename_action(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], **{c: [r[i] for r in rows] for i, c in enumerate(("status", "old_name", "new_name", "reason"))}})

    return tasks.select("id", "text").mapInPandas(run, "id bigint, status string, old_name string, new_name string, reason string")


def intents(tasks: DataFrame, key: list[str]) -> DataFrame:
    """``key`` columns and text -> ``key`` and intent."""
    from pyspark.sql.types import StringType, StructField, StructType

    ship(tasks.sparkSession)

    def run(batches):
        for pdf in batches:
            yield pdf[key].assign(intent=[intent_of(t) for t in pdf["text"]])

    kind = StructType([tasks.schema[c] for c in key] + [StructField("intent", StringType())])
    return tasks.select(*key, "text").mapInPandas(run, kind)


def task_text(event: Column) -> Column:
    """Text of a user message (struct role, content, parts, text): content, then parts, then text; distinct chunks by line.

    One layer of JSON text in the content is undone: an array of parts with a text each.
    """
    parts = F.from_json(event["content"], "array<struct<type:string,text:string>>")
    texts = F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda x: x.isNotNull()), "\n")
    content = F.when(F.startswith(F.ltrim(event["content"]), F.lit("[")) & parts.isNotNull(), texts).otherwise(event["content"])
    chunks = F.array_distinct(F.filter(F.concat(F.array(content), F.coalesce(event["parts"], F.array().cast("array<string>")), F.array(event["text"])), lambda x: x.isNotNull() & (x != "")))
    return F.when(event["role"] == "user", F.array_join(chunks, "\n"))
