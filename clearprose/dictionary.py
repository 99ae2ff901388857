"""Unapproved phrases and what to write instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clearprose.config import LintConfig

# Phrase forms by rule, each line one entry: forms = suggestion.
PHRASAL_VERBS = """
carry out, carries out, carried out, carrying out = do
spin up, spins up, spun up, spinning up = start
spin down, spins down, spun down, spinning down = stop
tear down, tears down, tore down, torn down, tearing down = remove
reach out, reaches out, reached out, reaching out = ask
dive into, dives into, dived into, dove into, diving into = examine
kick off, kicks off, kicked off, kicking off = start
roll out, rolls out, rolled out, rolling out = release
ramp up, ramps up, ramped up, ramping up = increase
circle back, circles back, circled back, circling back = return
drill down, drills down, drilled down, drilling down = examine
"""
HEDGING = """
it is important to note, it should be noted, it is worth noting, please note that, as mentioned, as noted above = delete
"""
MARKETING = """
seamless, seamlessly, robust, powerful, cutting-edge, effortless, effortlessly, world-class, next-generation, revolutionary, blazing, lightning-fast, elegant, delightful, turnkey, best-in-class, state-of-the-art, game-changing, battle-tested, enterprise-grade, supercharge, unleash, empower, empowers = delete
"""
NOT_APPROVED = """
initiate, initiates, initiated, initiating = start
commence, commences, commenced, commencing = start
utilize, utilizes, utilized, utilizing = use
utilise, utilises, utilised, utilising = use
ensure, ensures, ensured, ensuring = make sure
terminate, terminates, terminated, terminating = stop
facilitate, facilitates, facilitated, facilitating = help
locate, locates, located, locating = find
indicate, indicates, indicated, indicating = show
require, requires, required, requiring = need
purchase, purchases, purchased, purchasing = buy
leverage, leverages, leveraged, leveraging = use
acquire, acquires, acquired, acquiring = get
demonstrate, demonstrates, demonstrated, demonstrating = show
originate, originates, originated, originating = start
perform, performs, performed, performing = do
obtain, obtains, obtained, obtaining = get
attempt, attempts, attempted, attempting = try
assist, assists, assisted, assisting = help
permit, permits, permited, permiting = let
modify, modifies, modified, modifying = change
begin, begins, began, beginning = start
approximately = about
sufficient = enough
subsequent, subsequently = next
prior = before
additional, additionally = more
furthermore, moreover = also
comprehensive, comprehensively = complete
utilization = use
aforementioned = this
whilst = while
amongst = among
numerous, myriad, plethora = many
prior to = before
subsequent to = after
in order to = to
a variety of = some
in the event that = if
due to the fact that = because
is able to, are able to = can
make use of, makes use of = use
provenance = origin
ledger = log
"""
TABLES = {
    "phrasal-verb": PHRASAL_VERBS,
    "hedging": HEDGING,
    "marketing": MARKETING,
    "dictionary-not-approved-word": NOT_APPROVED,
}
SCHEMA = "rule_id string, entry_ord int, form_ord int, form string, phrase string, suggestion string"


def rows(config: LintConfig) -> list[tuple[str, int, int, str, str, str]]:
    """Forms of the rules that are on, blacklist included, whitelisted forms left out."""
    out = []
    for rule, table in TABLES.items():
        if config.severity(rule) is None:
            continue
        entries = [(line.split(" = ")[0].split(", "), line.split(" = ")[1]) for line in table.strip().splitlines()]
        if rule == "dictionary-not-approved-word":
            entries += [(list(e.unapproved), e.suggestions[0] if e.suggestions else "delete") for e in config.blacklist]
        out += [(rule, i, j, form.lower(), form, suggestion) for i, (forms, suggestion) in enumerate(entries) for j, form in enumerate(forms) if form.lower() not in config.exempt_forms and form]
    return out


def table(spark: SparkSession, config: LintConfig) -> DataFrame:
    return spark.createDataFrame(rows(config), SCHEMA)
