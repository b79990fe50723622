"""Cash maps: a borrower's accounts from structured JSON or free text, and which one a statement may be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyweave.functions.text import strip, strip_html
from tallyweave.operators.match import contained_pairs

# The questionnaire's wording.
SECTION = r"(?is)describe its purpose,?\s*bank.*?\n(.*?)(?=\n\s*4\.3|\z)"
ENTRY = r"(?s)Account\s+(\d+)\s*:\s*(.+?)(?=Account\s+\d+\s*:|\z)"
ENTRY_START = r"(?s)^Account\s+\d+\s*:\s*.+"
BORROWER = r"Borrower name:\s*(.+)"
BANK_HINT = r"(?:\bat\b|\bthrough\b|\bwith\b|\bvia\b)\s+([A-Z][A-Za-z.&' ]{2,40}?)(?=[.,\n]|$)"
EXTRA_LABEL = "Additional account (mentioned outside the numbered list)"

_JSON = (
    "struct<narrative:struct<borrower_name:string>,"
    "accounts:array<struct<id:string,label:string,bank_name:string,currency:string,purpose:string>>>"
)


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _account(id_: Column, label: Column, bank: Column, currency: Column, purpose: Column, description: Column) -> Column:
    return F.struct(
        id_.alias("id"), label.alias("label"), bank.alias("bank_name"), currency.alias("currency"),
        purpose.alias("purpose"), description.alias("description"),
    )


def _structured(js: Column) -> Column:
    def one(a: Column) -> Column:
        raw = F.coalesce(a["purpose"], F.lit(""))
        inner = F.when(raw.startswith("{"), F.coalesce(F.get_json_object(raw, "$.value"), F.lit(""))).otherwise(raw)
        purpose = (
            F.when(inner.startswith("["), F.coalesce(F.from_json(inner, "array<string>"), F.array(inner)))
            .when(inner == "", F.array().cast("array<string>")).otherwise(F.array(inner))
        )
        label = F.coalesce(F.nullif(a["label"], F.lit("")), a["id"], F.lit(""))
        told = F.when(F.size(purpose) > 0, F.concat(label, F.lit(" — "), F.array_join(purpose, ", "))).otherwise(label)
        return _account(
            F.coalesce(F.nullif(a["id"], F.lit("")), label), label, F.coalesce(a["bank_name"], F.lit("")),
            F.coalesce(a["currency"], F.lit("")), purpose, told,
        )

    return F.transform(F.filter(js["accounts"], lambda a: a.isNotNull()), one)


def _free_text(text: Column) -> tuple[Column, Column]:
    """(numbered accounts, body) of a free-text map."""
    section = F.when(text.rlike(SECTION), F.regexp_extract(text, SECTION, 1)).otherwise(text)
    body = F.regexp_replace(section, r"\[[^\]]*\]", "")

    def one(entry: Column) -> Column:
        number = F.regexp_extract(entry, ENTRY, 1)
        told = _squeeze(F.regexp_extract(entry, ENTRY, 2))
        return _account(
            F.concat(F.lit("account_"), number), F.concat(F.lit("Account "), number),
            strip(F.regexp_extract(told, BANK_HINT, 1)), F.lit(""), F.array(told), told,
        )

    return F.transform(F.regexp_extract_all(body, F.lit(ENTRY), F.lit(0)), one), body


def _extras(numbered: Column, body: Column) -> Column:
    """Escrow lines outside the numbered entries."""
    told = F.array_join(F.transform(numbered, lambda a: a["description"]), " ")
    loose = F.filter(
        F.transform(F.split(body, r"\R"), _squeeze),
        lambda l: (l != "") & ~l.rlike(ENTRY_START) & ~F.contains(told, l) & F.lower(l).contains("escrow"),
    )
    return F.transform(
        loose,
        lambda l, k: _account(
            F.concat(F.lit("account_extra_"), (F.size(numbered) + k + 1).cast("string")), F.lit(EXTRA_LABEL),
            strip(F.regexp_extract(l, BANK_HINT, 1)), F.lit(""), F.array(l), l,
        ),
    )


def parse(maps: DataFrame) -> DataFrame:
    """``file, text`` -> ``file, borrower_name, source, accounts``. Structured JSON first, then free text.

    Files named .html are stripped of tags. All inside the row, nothing is shuffled.
    """
    text = F.when(F.lower("file").endswith(".html"), strip_html(F.col("text"))).otherwise(F.col("text"))
    base = maps.select(*[c for c in maps.columns if c != "text"], text.alias("text")).withColumn(
        "js", F.when(F.lower("file").endswith(".json"), F.from_json("text", _JSON))
    )
    structured = F.size(F.coalesce(F.col("js.accounts"), F.expr("array()"))) > 0
    numbered, body = _free_text(F.col("text"))
    free = base.withColumn("_s", structured).withColumn("_body", F.when(~F.col("_s"), body)).withColumn(
        "_numbered", F.when(~F.col("_s"), numbered)
    )
    accounts = F.when(F.col("_s"), _structured(F.col("js"))).otherwise(
        F.concat(F.col("_numbered"), _extras(F.col("_numbered"), F.col("_body")))
    )
    name = F.when(F.col("_s"), F.coalesce(F.col("js.narrative.borrower_name"), F.lit(""))).otherwise(
        strip(F.regexp_extract("text", BORROWER, 1))
    )
    return free.select(
        *[c for c in maps.columns if c != "text"], name.alias("borrower_name"),
        F.when(F.col("_s"), "structured_json").otherwise("free_text").alias("source"), accounts.alias("accounts"),
    )


def accounts(parsed: DataFrame) -> DataFrame:
    """One row per account."""
    return parsed.select(*[c for c in parsed.columns if c != "accounts"], F.posexplode("accounts").alias("position", "a")).select(
        *[c for c in parsed.columns if c != "accounts"], "position", "a.*"
    )


def candidates(statements: DataFrame, account_rows: DataFrame, key: str = "borrower") -> DataFrame:
    """Accounts a statement may belong to: those whose bank it names, else all of its borrower.

    ``statements``: ``file`` (unique), ``key`` and ``text``. Named accounts meet by
    borrower and bank name, so a statement is not paired with accounts it does
    not name; only the fallback lists every account, as it is meant to.
    """
    named_account = account_rows.withColumn("bank_key", F.lower("bank_name"))
    hays = statements.select(F.col("file").alias("hay_id"), F.lower(F.concat_ws("\n", "text", "file")).alias("hay"))
    needles = named_account.filter(F.col("bank_key") != "").select(F.col("bank_key").alias("needle"))
    mentions = contained_pairs(needles, hays).select(F.col("hay_id").alias("file"), F.col("needle").alias("bank_key"))
    shown = ["position", "id", "label", "bank_name"]
    who = statements.select("file", key)
    by_name = mentions.join(who, "file").join(named_account.select(key, "bank_key", *shown), [key, "bank_key"])
    by_name = by_name.select(key, "file", *shown)
    rest = who.join(by_name.select("file").distinct(), "file", "left_anti").join(account_rows.select(key, *shown), key)
    both = by_name.withColumn("by_name", F.lit(True)).unionByName(
        rest.select(key, "file", *shown).withColumn("by_name", F.lit(False))
    )
    return both.withColumnRenamed("file", "account_ref")
