"""Sentences, rule-likeness and quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: words of obligation.
OBLIGATION = r"(?i)\b(must|should|shall|never|always|do not|don't|avoid|required?|prefer|instead of|make sure|ensure|recommended|mandatory)\b"
#: Fixed value: how an instruction opens: a condition, a request, then the verb.
_OPENING = r"(?i)^((if|when|for|before|after|while|once|unless|in)\b[^,:]{0,80}[,:]\s*)?(please\s+)?([a-z-]+)"
#: Imperative verbs that open an instruction: everyday verbs of development, a parameter of ``reads_like_rule``.
VERBS = tuple(
    """add align allow analyze annotate append apply ask assert assign assume attach audit batch build bump cache call capture catch change check choose clean clear close
    collect combine comment commit compare compile compose compute configure confirm connect consider consult convert copy cover create debug declare decouple define delegate
    delete deploy describe design disable discuss do document download drop duplicate edit emit enable encode enforce escape evaluate exclude execute expect explain export
    expose extend extract fetch filter find fix focus follow format generate get give go group guard handle hide implement import include inherit initialize inject inline
    insert inspect install keep know label leave let limit link lint list load log look maintain make map mark match measure merge migrate minimize mock modify mount move name
    normalize note open optimize organize override parse pass perform pick pin place plan prefix prepare preserve prevent print prioritize propagate protect provide publish
    pull push put query raise read rebase refactor refer register reject release rely remember remove rename render replace report request resolve respect restart restrict
    return reuse review rewrite run sanitize save schedule see select send separate serialize set share show simplify skip sort specify split squash start state stop store
    structure submit switch sync tag take test throw track treat trigger trim try type update upgrade upload use validate verify version wait watch wrap write""".split()
)
#: Our sentence rule: a sentence ends with . ! or ? before a space, or with its line.
SENTENCE_END = r"(?<=[.!?])\s+"


def sentences(text: Column) -> Column:
    """array<struct<line, text>>: the non-empty sentences of each line, lines from 1."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    per_line = F.transform(lines, lambda line, i: F.transform(F.filter(F.split(F.trim(line), SENTENCE_END), lambda s: s != ""), lambda s: F.struct((i + 1).cast("long").alias("line"), s.alias("text"))))
    return F.flatten(per_line)


def reads_like_rule(sentence: Column, verbs: tuple[str, ...] = VERBS) -> Column:
    return sentence.rlike(OBLIGATION) | F.lower(F.regexp_extract(sentence, _OPENING, 4)).isin(*verbs)


def plain(markdown: Column) -> Column:
    """Markdown without emphasis and code marks, with plain quotes and single spaces."""
    return F.trim(F.regexp_replace(F.translate(markdown, "‘’“”*_`", "''\"\""), r"\s+", " "))


def line_lengths(text: Column) -> Column:
    """Lengths of a text's lines once they are plain."""
    return F.transform(F.split(text, "\n"), lambda line: F.length(plain(line)))


def line_at(body: Column, lengths: Column, quote: Column) -> Column:
    """The line, from 1, on which a quote begins in a text that is plain (``body``, ``line_lengths``) once it is plain too; null if it is not there."""
    at = F.instr(body, plain(quote))

    def step(s: Column, n: Column) -> Column:
        """Characters of the plain text so far, and lines that end before the quote; its place is handed on, not found anew for each line."""
        total = F.when(n > 0, s["total"] + n + F.when(s["total"] > 0, 1).otherwise(0)).otherwise(s["total"])
        return F.struct(total.alias("total"), (s["passed"] + F.when(total < s["at"], 1).otherwise(0)).alias("passed"), s["at"].alias("at"))

    passed = F.aggregate(lengths, F.struct(F.lit(0).alias("total"), F.lit(0).alias("passed"), at.alias("at")), step, lambda s: s["passed"])
    return F.when((at > 0) & (F.length(plain(quote)) > 0), passed + 1)


def quote_line(text: Column, quote: Column) -> Column:
    """``line_at`` of a text as it is."""
    return line_at(plain(text), line_lengths(text), quote)
