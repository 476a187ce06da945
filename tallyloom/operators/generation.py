"""Examples of questions and their targets, made by rule: vocabularies of splits, templates of categories, quotas.

Row i of a dataset runs through categories first, then names, periods and registers: it depends on i alone, so that any part of a dataset can be made anywhere, without a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GIVEN = [
    "Asha", "Bhanu", "Charu", "Divakar", "Eshan", "Farida", "Gauri", "Harini", "Indu", "Jaya", "Kamal", "Lata", "Mohan",
    "Nalini", "Omkar", "Prema", "Rahul", "Sarita", "Tara", "Usha", "Vimala", "Waman", "Yamuna", "Zeenat", "Balan",
]
FAMILY = ["Iyer", "Joshi", "Pawar", "Shetty", "Menon", "Pillai", "Desai", "Mishra", "Nair", "Bhat"]
STRANGER = ["Olga", "Pedro", "Quinn", "Rosa", "Stefan", "Theo", "Ulla", "Viktor", "Wanda", "Xenia", "Yann", "Zora", "Aldo", "Britt", "Carlo", "Dora", "Emil"]
INITIALS = ["B.", "D. K.", "M. N.", "P. V. S.", "T."]
#: Names of each split, and of those that no register holds.
SPLITS = {"train": (95, 30), "validation": (25, 15), "test": (30, 20), "hard_test": (30, 20)}
AMBIGUOUS = 10


def vocabulary(split: str) -> list[str]:
    """Names of a split. Splits take turns at the pairs of given and family names, so that none is in two; the hard ones have initials."""
    turns = {"train": (0, 1, 2, 3), "validation": (4,), "test": (5,), "hard_test": (6,)}[split]
    pairs = [(g, f) for g in GIVEN for f in FAMILY]
    chosen = [(g, f, i) for i, (g, f) in enumerate(pairs) if i % 7 in turns][: SPLITS[split][0]]
    return [f"{INITIALS[i % len(INITIALS)]} {g} {f}" if split == "hard_test" else f"{g} {f}" for g, f, i in chosen]


def strangers(split: str) -> list[str]:
    """Names of a split that no registry holds."""
    every = [f"{i} {n}" for n in STRANGER for i in INITIALS]
    at = 0
    for name, (_, many) in SPLITS.items():
        if name == split:
            return every[at : at + many]
        at += many
    raise KeyError(split)


def ambiguous() -> list[tuple[str, list[str]]]:
    """Given names with two people each."""
    return [(g, [f"{g} {FAMILY[i]}", f"{g} {FAMILY[i - 1]}"]) for i, g in enumerate(GIVEN[:AMBIGUOUS])]


#: (period, how a question says it)
WHEN = [("TODAY", "today"), ("YESTERDAY", "yesterday"), ("THIS_WEEK", "this week"), ("LAST_WEEK", "last week"), ("THIS_MONTH", "this month"), ("LAST_MONTH", "last month"), ("SINCE_MONDAY", "since monday"), ("LAST_SUNDAY", "last sunday")]
REGISTERS = [("standard", "{}?"), ("short", "{}"), ("indian_english", "kindly tell {} only"), ("bad_grammar", "{} is what"), ("word_order", "tell me this, {}"), ("paraphrase", "i would like to know {}")]

_T = '"time":{"type":"RELATIVE","period":"{period}"}'
_E = '"entity":"{who}"'
_Q = '"aggregations":[{"type":"SUM","field":"QUANTITY"}]'
_BY = '"groupBy":["FARMER_NAME"]'
_agg = lambda kind, field: f'"aggregations":[{{"type":"{kind}","field":"{field}"}}]'
_if = lambda field, op, value: f'{{"field":"{field}","op":"{op}","value":"{value}"}}'
#: (category, register or None for all in turn, the question, what its target says)
TEMPLATES: list[tuple[str, str | None, str, str]] = [
    ("simple_field_lookup", None, "what is the fat of {who}", f'{_E},"select":["FAT"]'),
    ("single_farmer_lookup", None, "how did {who} do", f'{_E},"select":["QUANTITY","FAT","SNF"]'),
    ("multi_field_lookup", None, "fat and snf of {who}", f'{_E},"select":["FAT","SNF"]'),
    ("time_constrained_lookup", None, "fat of {who} {when}", f'{_E},"select":["FAT"],{_T}'),
    ("sum_aggregation", None, "total milk of {who} {when}", f"{_E},{_Q},{_T}"),
    ("avg_aggregation", None, "average fat of {who} {when}", f"{_E},{_agg('AVG', 'FAT')},{_T}"),
    ("min_aggregation", None, "lowest snf of {who} {when}", f"{_E},{_agg('MIN', 'SNF')},{_T}"),
    ("max_aggregation", None, "highest quantity of {who} {when}", f"{_E},{_agg('MAX', 'QUANTITY')},{_T}"),
    ("count_records", None, "how many deliveries {who} made {when}", f'{_E},"aggregations":[{{"type":"COUNT_RECORDS"}}],{_T}'),
    ("count_distinct_farmers", None, "how many farmers came {when}", f'"aggregations":[{{"type":"COUNT_DISTINCT_FARMERS"}}],{_T}'),
    ("numeric_filter", None, "entries over {n} litres {when}", f'"filters":[{_if("QUANTITY", "GREATER_THAN", "{n}")}],{_T}'),
    ("equality_filter", None, "entries paid in cash {when}", f'"filters":[{_if("PAYMENT_METHOD", "EQUALS", "CASH")}],{_T}'),
    ("not_null_filter", None, "entries with a reference {when}", f'"filters":[{{"field":"PAYMENT_REFERENCE","op":"IS_NOT_NULL"}}],{_T}'),
    ("and_logic_filter", None, "entries over {n} litres with fat over 4", f'"filters":[{_if("QUANTITY", "GREATER_THAN", "{n}")},{_if("FAT", "GREATER_THAN", "4")}],"filterLogic":"AND"'),
    ("or_logic_filter", None, "entries over {n} litres or with fat over 4", f'"filters":[{_if("QUANTITY", "GREATER_THAN", "{n}")},{_if("FAT", "GREATER_THAN", "4")}],"filterLogic":"OR"'),
    ("group_by", None, "total milk by farmer {when}", f"{_Q},{_BY},{_T}"),
    ("having_filter", None, "farmers with a total over {n} litres {when}", f'{_Q},{_BY},"havingFilter":{{"agg":"SUM","field":"QUANTITY","op":"GREATER_THAN","value":{{n}}}},{_T}'),
    ("order_by_field", None, "entries by fat, best first, {when}", f'"orderBy":{{"target":"FIELD","field":"FAT","dir":"DESC"}},{_T}'),
    ("order_by_aggregate", None, "farmers by total milk {when}", f'{_Q},{_BY},"orderBy":{{"target":"AGGREGATE","aggregation":"SUM"}},{_T}'),
    ("limit_query", None, "the last {n} entries {when}", f'"orderBy":{{"target":"FIELD","field":"CREATED_AT","dir":"DESC"}},"limit":{{n}},{_T}'),
    ("exists_query", None, "did {who} come {when}", f'{_E},"exists":true,{_T}'),
    ("payment_status", None, "is {who} paid", f'{_E},"select":["PAYMENT_STATUS"]'),
    ("payment_method", None, "how was {who} paid", f'{_E},"select":["PAYMENT_METHOD"]'),
    ("payment_reference", None, "the payment reference of {who}", f'{_E},"select":["PAYMENT_REFERENCE"]'),
    ("amount_paid", None, "the amount paid to {who} {when}", f'{_E},"select":["AMOUNT_PAID"],{_T}'),
    ("payment_timestamp", None, "when was {who} paid", f'{_E},"select":["PAYMENT_TIMESTAMP"]'),
    ("upload_status", None, "is the entry of {who} uploaded", f'{_E},"select":["UPLOAD_STATUS"]'),
    ("multi_aggregation", None, "total milk and average fat {when}", f'"aggregations":[{{"type":"SUM","field":"QUANTITY"}},{{"type":"AVG","field":"FAT"}}],{_T}'),
    ("payment_scope_all", None, "are all entries of {who} paid", f'{_E},"select":["PAYMENT_STATUS"],"paymentScope":"ALL"'),
    ("payment_scope_any", None, "is any entry of {who} paid", f'{_E},"select":["PAYMENT_STATUS"],"paymentScope":"ANY"'),
    ("conditional_query", None, "if {who} is paid say how, else what is due", f'{_E},"conditionalSpec":{{}}'),
    ("explicit_date", None, "milk of {who} on 2026-09-{n}", f'{_E},{_Q},"time":{{"type":"EXPLICIT_DATE","date":"2026-09-{{n}}"}}'),
    ("explicit_range", None, "total milk from 2026-08-{n} to 2026-09-{n}", f'{_Q},"time":{{"type":"EXPLICIT_RANGE","startDate":"2026-08-{{n}}","endDate":"2026-09-{{n}}"}}'),
    ("relative_date", None, "total milk {when}", f"{_Q},{_T}"),
    ("read_write_contrast", None, "record {n} litres of {who}", '"type":"WRITE","writeArgs":{"farmerName":"{who}","quantity":"{n}"}'),
    ("ambiguous_entity", None, "total milk of {given} {when}", '"type":"CLARIFY","reason":"ambiguous name {given}"'),
    ("unknown_entity", None, "total milk of {stranger} {when}", '"type":"CLARIFY","reason":"{stranger} is not registered"'),
    ("missing_field", None, "tell me about {who} {when}", f'"type":"CLARIFY",{_E},"reason":"unspecified field"'),
    ("unsupported_request", None, "why did {who} give less {when}", f'"type":"UNSUPPORTED",{_E},"reason":"no causes are recorded"'),
    ("conversational_pronoun", None, "and what did she give {when}", '"type":"CLARIFY","reason":"ambiguous pronoun"'),
    *(("linguistic_variation", r, "total milk of {who} {when}", f"{_E},{_Q},{_T}") for r, _ in (REGISTERS[2], REGISTERS[3], REGISTERS[1], REGISTERS[4], REGISTERS[5])),
    ("multi_condition", None, "pending entries over {n} litres {when}", f'"filters":[{_if("QUANTITY", "GREATER_THAN", "{n}")},{_if("PAYMENT_STATUS", "EQUALS", "PENDING")}],{_T}'),
    ("compositional_query", None, "the {n} farmers with the most milk {when}", f'{_Q},{_BY},"orderBy":{{"target":"AGGREGATE","aggregation":"SUM"}},"limit":{{n}},{_T}'),
]


def _from(items: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, items)), at.cast("int"))


def examples(spark: SparkSession, split: str, n: int) -> DataFrame:
    """gen_idx, split, category, register, prompt, target (JSON): n examples of a split."""
    i = F.col("id")
    many = len(TEMPLATES)
    names, others, given = vocabulary(split), strangers(split), [g for g, _ in ambiguous()]
    kind, turn = i % many, F.floor(i / many)
    when = (turn % len(names) + F.floor(turn / len(names))) % len(WHEN)  # each name meets each period, and questions without a name run through periods too
    by_turn = F.floor(turn / len(WHEN)) % len(REGISTERS)
    fixed = {r: k for k, (r, _) in enumerate(REGISTERS)}
    own = _from([str(fixed.get(r, -1)) for _, r, _, _ in TEMPLATES], kind).cast("int")
    register = F.when(own >= 0, own).otherwise(by_turn)
    values = {
        "who": _from(names, turn % len(names)), "stranger": _from(others, turn % len(others)), "given": _from(given, turn % len(given)),
        "when": _from([w for _, w in WHEN], when), "period": _from([p for p, _ in WHEN], when), "n": (turn % 9 + 10).cast("int").cast("string"),
    }

    def filled(text: Column) -> Column:
        for name, value in values.items():
            text = F.replace(text, F.lit("{" + name + "}"), value)
        return text

    said = F.replace(_from([w for _, w in REGISTERS], register), F.lit("{}"), filled(_from([q for _, _, q, _ in TEMPLATES], kind)))
    return spark.range(n).select(
        i.alias("gen_idx"), F.lit(split).alias("split"), _from([c for c, _, _, _ in TEMPLATES], kind).alias("category"), _from([r for r, _ in REGISTERS], register).alias("register"),
        said.alias("prompt"), F.concat(F.lit("{"), filled(_from([t for _, _, _, t in TEMPLATES], kind)), F.lit("}")).alias("target"),
    )


# The grammar: how questions vary in words. A template's fixed words become slots; a row's turn chooses an option for each, in mixed radix.
#: (words of a template, the slot in their place)
WORDS_OF = (("total milk", "{total}"), ("average", "{mean}"), ("lowest", "{least}"), ("highest", "{greatest}"), ("entries", "{entries}"))
#: What a slot may say. Each option holds a word by which a prompt shows what its target asks for.
OPTIONS = {
    "total": ["total milk", "milk in all", "the sum of milk", "how much milk"], "mean": ["average", "mean", "avg", "overall average"], "least": ["lowest", "minimum", "smallest", "very lowest"],
    "greatest": ["highest", "maximum", "largest", "very highest"], "entries": ["entries", "deliveries", "collections", "rows"],
}
#: How a question begins.
OPENINGS = ["", "please show ", "i need ", "quickly, "]
#: How many turns each digit has, the fastest first: periods, phrases, openings, registers, numbers.
RADIX = {"when": len(WHEN), "phrase": 4, "opening": len(OPENINGS), "register": len(REGISTERS), "n": 9}


def skeletons() -> list[str]:
    """The templates' questions with slots for their fixed words."""
    out = []
    for _, _, question, _ in TEMPLATES:
        for words, slot in WORDS_OF:
            question = question.replace(words, slot)
        out.append(question)
    return out


def grammar_examples(names: DataFrame, key: str = "key", name: str = "name") -> DataFrame:
    """gen_idx, category, register, prompt, target (JSON): every template for every name, in the words that the name's key chooses.

    names: key (a unique long from 0 on), name. Rows are made where the names are: no shuffle, no
    loop. Strangers and shared given names come from the vocabulary, as no register holds them.
    """
    many = len(TEMPLATES)
    digit, left = {}, F.col("_turn")
    for d, base in RADIX.items():
        digit[d], left = left % base, F.floor(left / base)
    rows = names.select(F.col(key).cast("long").alias("_turn"), F.col(name).alias("_who"), F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("_kind"))
    turn, kind = F.col("_turn"), F.col("_kind")
    others, given = strangers("train"), [g for g, _ in ambiguous()]
    fixed = {r: k for k, (r, _) in enumerate(REGISTERS)}
    own = _from([str(fixed.get(r, -1)) for _, r, _, _ in TEMPLATES], kind).cast("int")
    register = F.when(own >= 0, own).otherwise(digit["register"])
    values = {slot: _from(options, digit["phrase"]) for slot, options in OPTIONS.items()} | {
        "who": F.col("_who"), "stranger": _from(others, turn % len(others)), "given": _from(given, turn % len(given)),
        "when": _from([w for _, w in WHEN], digit["when"]), "period": _from([p for p, _ in WHEN], digit["when"]), "n": (digit["n"] + 10).cast("int").cast("string"),
    }

    def filled(text: Column) -> Column:
        for slot, value in values.items():
            text = F.replace(text, F.lit("{" + slot + "}"), value)
        return text

    question = F.concat(_from(OPENINGS, digit["opening"]), filled(_from(skeletons(), kind)))
    return rows.select(
        (turn * many + kind).alias("gen_idx"), _from([c for c, _, _, _ in TEMPLATES], kind).alias("category"), _from([r for r, _ in REGISTERS], register).alias("register"),
        F.replace(_from([w for _, w in REGISTERS], register), F.lit("{}"), question).alias("prompt"), F.concat(F.lit("{"), filled(_from([t for _, _, _, t in TEMPLATES], kind)), F.lit("}")).alias("target"),
    )


def quotas(split: str) -> dict[int, int]:
    """How many examples of each category (by number) a split takes. Compositions (46) are kept out of training."""
    if split == "pilot":
        return {c: 11 if c <= 40 else 10 for c in range(1, 47)}
    if split == "train":
        return {c: 133 if c <= 7 else 135 if c == 36 else 0 if c == 46 else 132 for c in range(1, 47)}
    return {c: 40 if c == 46 else 18 for c in range(1, 47)}
