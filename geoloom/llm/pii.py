"""Personal data by weak supervision, with DataFrame functions alone.

Candidates come from patterns. Strict ones (email, ip, card, phone, checked by their rules) are base spans and always
stay. Loose ones (spelt-out emails, phone numbers without a plus, names after a title or from a gazetteer) are kept if
the final classifier says so. Five labelers vote for (1), against (-1) or abstain (0) on every candidate: a second
regular expression for the usual way to write it, its arithmetic (Luhn, ranges, numbering plan, lengths), a gazetteer
(top-level domains, card issuers, calling codes, given names), words before it that tell of contact or of something else,
and words and signs around it that speak against it.

Expectation-maximisation over the counts of vote patterns (a fixed number of rows) estimates, for each kind of
candidate, how common personal data is among them and how often each labeler is right when it votes. Nothing bounds the
estimates; pseudo-counts (right in 8 of 10 votes, one candidate in three, of names two) decide only where a corpus says
little. What votes can't tell is not estimated from them: a labeler that only ever votes one way would confirm itself, so
it takes no part in the rounds and is measured once by what the others found, and where fewer than three vote both ways the
classes stay open and pseudo-counts stand. Labelers that nearly always say the same share one say. Names after a title and
after a given name are kinds of their own, as the word that makes them candidates is no independent vote. A logistic
classifier over votes and length is then trained for each kind on the probabilities of the patterns seen, and with little
weight on those of all other patterns, so that it decides on patterns that come up later, too.

Titles, given names, domains and places come from gazetteers, which are an input (``Gazetteers.read`` takes a table).

All counts cover all rows. Positions are code points, end exclusive. Spans of the loose patterns that touch a base span,
or an earlier loose one, are left out. A null text is empty. Repeated rows are handled each. Without candidates
only the priors decide. Columns of any names may stand beside the text; they stay as they are.
"""

from __future__ import annotations

import functools
import itertools
import re
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "name")
THRESHOLD = 0.5
CONTEXT = 32
_CHUNK = 256

# The patterns, in forms that read each text once (runs are entered at their start and never left).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELT_EMAIL = r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,64}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,32}|\.[A-Za-z0-9-]{1,32}){1,4}"
LOCAL_PHONE = r"(?<![0-9A-Za-z+.-])(?<![0-9][\x20])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])(?![\x20.][0-9])"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
FOR = r"(?i)(?:e-?mail|mail|contact|kontakt|contacto|correo|courriel|write to|reach|call|tel|tél|phone|fon|téléphone|teléfono|fax|mobile|handy|card|karte|tarjeta|carte|visa|credit|address|adresse|name|nom|nombre|dear|liebe|lieber|cher|chère|estimado|estimada|ip|host)\W{0,3}$"
AGAINST = r"(?i)(?:version|isbn|issn|serial|order|invoice|figure|fig|section|chapter|no\.|nr\.|id|§|#|\$|€|=)\W{0,2}$"

# First a sign that some pattern with digits can match, then a test for each pattern: most texts are read once.
DIGITS = r"[0-9][0-9.\x20()-]"

#: Entries of all gazetteers together, which become patterns.
MOST_ENTRIES = 20_000


@dataclass(frozen=True)
class Gazetteers:
    """Alternatives of words, as patterns: what stands before a name, given names, top-level domains, and words that make
    a place or an institution of what looks like a name. The defaults are a start; a corpus wants lists of its own."""

    titles: str = "Mr|Mrs|Ms|Miss|Mx|Sir|Lady|Dr|Prof|Rev|Herr|Frau|Herrn|Monsieur|Madame|Mademoiselle|Mme|Mlle|Maître|Señor|Señora|Señorita|Sr|Sra|Srta|Don|Doña"
    names: str = (
        "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Christopher|Daniel|Matthew|Anthony|Mark|Donald|Steven|Andrew|Paul|Joshua|Kenneth|Kevin|Brian|George|Edward|Ronald|Timothy|Jason|Jeffrey|Ryan|Jacob|Gary|Nicholas|Eric|Jonathan|Stephen|Larry|Justin|Scott|Brandon|"
        "Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Nancy|Lisa|Betty|Margaret|Sandra|Ashley|Kimberly|Emily|Donna|Michelle|Carol|Amanda|Dorothy|Melissa|Deborah|Stephanie|Rebecca|Sharon|Laura|Cynthia|Kathleen|Amy|Angela|Shirley|Anna|Emma|"
        "Hans|Peter|Klaus|Jürgen|Wolfgang|Günter|Dieter|Stefan|Andreas|Uwe|Bernd|Matthias|Frank|Jens|Ursula|Monika|Petra|Sabine|Renate|Helga|Karin|Brigitte|Ingrid|Erika|Andrea|Claudia|Susanne|Gabriele|Heike|Anja|"
        "Jean|Pierre|Philippe|Alain|Patrick|Nicolas|Christophe|Laurent|Frédéric|Julien|François|Jacques|Olivier|Marie|Nathalie|Isabelle|Sylvie|Catherine|Françoise|Valérie|Christine|Monique|Sophie|Sandrine|Céline|Claude|Camille|"
        "José|Juan|Antonio|Manuel|Francisco|Javier|Carlos|Jesús|Miguel|Alejandro|Rafael|Pedro|Pablo|Luis|Fernando|Carmen|María|Josefa|Isabel|Dolores|Pilar|Teresa|Ana|Lucía|Cristina|Marta|Elena|Rosa"
    )
    domains: str = "com|org|net|edu|gov|mil|int|info|biz|io|co|me|tv|app|dev|eu|uk|us|ca|au|nz|ie|in|de|at|ch|li|fr|be|lu|es|mx|ar|cl|pe|ve|it|nl|pt|br|pl|cz|se|no|dk|fi|gr|ru|ua|tr|jp|cn|kr|za"
    places: str = "Street|St|Avenue|Ave|Road|Rd|Lane|Boulevard|Square|Bridge|Park|Hall|House|School|College|University|Institute|Library|Museum|Hospital|Church|Airport|Station|Inc|Ltd|LLC|GmbH|AG|SA|Foundation|Prize|Award|Medal|Act|Theorem|Straße|Platz|Schule|Preis|Rue|Calle|Plaza|Premio|Prix"

    @classmethod
    def read(cls, entries: DataFrame) -> "Gazetteers":
        """From rows (list, entry), where list is the name of a gazetteer; lists without rows keep their defaults."""
        rows = entries.where("entry is not null and entry <> ''").select("list", "entry").distinct().limit(MOST_ENTRIES + 1).collect()
        if len(rows) > MOST_ENTRIES:
            raise ValueError(f"gazetteers may have {MOST_ENTRIES} entries")
        known = {f.name for f in fields(cls)}
        if unknown := {r["list"] for r in rows} - known:
            raise ValueError(f"no such gazetteers: {sorted(map(str, unknown))}")
        # longer entries first, so that none hides behind its own beginning
        return cls(**{name: "|".join(re.escape(e) for e in sorted((r["entry"] for r in rows if r["list"] == name), key=lambda e: (-len(e), e))) for name in {r["list"] for r in rows}})


def patterns(lists: Gazetteers) -> tuple:
    """(name, kind, base, pattern, whether it needs digits, strings of which one must occur, test or None)"""
    word = r"\x20\p{Lu}\p{Ll}{1,24}(?![\p{L}])"
    titled, given = rf"(?:{lists.titles})\.?", rf"(?:{lists.names})"
    return (
        ("email", "email", True, EMAIL, False, ("@",), None),
        ("ip", "ip", True, IP, True, (".",), r"[0-9]\.[0-9]"),
        ("card", "card", True, CARD, True, (), r"[0-9](?:[\x20-]?[0-9]){13}"),
        ("phone", "phone", True, PHONE, True, ("+",), r"\+[0-9]"),
        ("spelt", "email", False, SPELT_EMAIL, False, ("at)", "at]"), r"[\[(]at[\])]"),
        ("local", "phone", False, LOCAL_PHONE, True, (), r"[0-9]{3}[\x20.-][0-9]{4}"),
        ("titled", "name", False, rf"(?=\p{{Lu}})(?<![\p{{L}}]){titled}{word}", False, (), rf"(?=\p{{Lu}}){titled}\x20\p{{Lu}}"),
        ("given", "name", False, rf"(?=\p{{Lu}})(?<![\p{{L}}]){given}{word}", False, (), rf"(?=\p{{Lu}}){given}\x20\p{{Lu}}"),
    )


PATTERNS = tuple(p[:3] for p in patterns(Gazetteers()))
VOTERS = ("usual", "checks", "gazetteer", "context", "around")
#: Pseudo-counts: right and wrong votes of each labeler, and candidates that are personal data and that aren't; of names
#: after a title or a given name most are.
RIGHT, WRONG, YES, NO = 8.0, 2.0, 1.0, 2.0
RIGHT_AROUND, WRONG_AROUND = 9.0, 1.0
TELLING = {"titled": (2.0, 1.0), "given": (2.0, 1.0)}
#: Labelers that say the same on this share of the candidates share one vote.
SAME = 0.99
#: A labeler votes both ways if the rarer one is this share of its votes and so many; so many such labelers tell classes.
RARER_SHARE, RARER, ENOUGH = 0.01, 20, 3
ROUNDS = 1000
#: Weight of a vote pattern that the corpus doesn't show in the training of the classifier.
UNSEEN = 0.05


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    """Whether a base match passes the checks of its kind."""
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        return F.call_function("luhn_check", _digits(value))  # the pattern holds the number of digits
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(no if no is not None else ~yes, -1).otherwise(0)


def votes(name: str, value: Column, before: Column, after: Column, lists: Gazetteers) -> list[Column]:
    """The labelers' votes on a candidate and the text around it, in the order of VOTERS."""
    n = F.length(_digits(value))
    odd = after.rlike(r"^[\p{L}\p{N}_=]")
    if name in ("email", "spelt"):
        usual = _vote(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}$")) if name == "email" else _vote(value.rlike(r"[\[(]dot[\])]\x20?[A-Za-z]{2,}$"), value.rlike("[0-9]$"))
        checks = _vote(F.length(value).between(6, 254), F.lit(True))
        gazetteer = _vote(value.rlike(rf"(?i)(?:\.|dot[\])]\x20?)(?:{lists.domains})$"))
    elif name == "ip":
        usual = _vote(value.rlike(r"^(?:[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"))
        checks = _vote(valid("ip", value))
        gazetteer = _vote(value.rlike(r"^(?:10|127|172|192|169)\."), value.rlike(r"^(?:0|22[4-9]|23[0-9]|2[4-9][0-9])\."))
    elif name == "card":
        usual = _vote(value.rlike(r"^(?:[0-9]{4}(?:[\x20-]?)){3}[0-9]{4}$|^[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}$"))
        checks = _vote(valid("card", value))
        gazetteer = _vote(value.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6)"))
    elif name == "phone":
        usual = _vote(value.rlike(r"^\+[1-9][0-9]{0,2}[\x20(.-]"), value.rlike(r"^\+0"))
        checks = _vote(n.between(10, 15))
        gazetteer = _vote(value.rlike(r"^\+(?:1|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-6]|7|8[1-6]|9[0-8])"))
    elif name == "local":
        usual = _vote(value.rlike(r"^\("), ~value.rlike(r"^[0-9]{3}([\x20.-])[0-9]{3}\1[0-9]{4}$"))
        checks = _vote(value.rlike(r"^\(?[2-9][0-8][0-9]\)?[\x20.-]?[2-9]"))  # area code and exchange of the numbering plan
        gazetteer = _vote(value.rlike(r"^\(?(?:800|888|877|866|855|844|833)"), value.rlike(r"^\(?(?:900|976|[0-9]11)"))
    else:
        usual = _vote(value.rlike(rf"^(?:{lists.titles})\b"), F.lit(False))
        checks = _vote(F.lit(False), F.length(F.substring_index(value, " ", -1)) < 3)
        gazetteer = _vote(value.rlike(rf"(?:^|\x20)(?:{lists.names})(?:\x20|$)"), F.lit(False))
        odd = odd | value.rlike(rf"\x20(?:{lists.places})$") | after.rlike(rf"^\x20(?:{lists.places})\b")
    context = F.when(before.rlike(AGAINST), -1).when(before.rlike(FOR), 1).otherwise(0)
    around = F.when(odd, -1).otherwise(0)
    return [usual, checks, gazetteer, context, around]


def _may(text: Column, digits: Column, needs: bool, strings: tuple, test: str | None) -> Column:
    """A cheap test whether a pattern may match; it reads no more than it must."""
    may = digits if needs else F.lit(True)
    if strings:
        may = may & functools.reduce(lambda a, b: a | b, [F.instr(text, s) > 0 for s in strings])
    return may & text.rlike(test) if test else may


def _matched(text: Column, pattern: str, may: Column) -> tuple[Column, Column]:
    """(texts between the matches, matches); empty arrays where the test fails."""
    none = F.array().cast("array<string>")
    return F.when(may, F.split(text, pattern, -1)).otherwise(none), F.when(may, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none)


def _starts(pieces: Column, found: Column) -> Column:
    """Start of each match. Sums run in chunks, so that no list is copied once for each match."""
    lens = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len")))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _CHUNK).cast("int")), lambda c: F.slice(lens, c * _CHUNK + 1, F.lit(_CHUNK)))
    none = F.array().cast("array<int>")
    sums = F.transform(chunks, lambda ch: F.aggregate(ch, F.lit(0), lambda a, x: a + x["gap"] + x["len"]))
    offsets = F.aggregate(sums, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
    each = F.zip_with(chunks, offsets, lambda ch, off: F.aggregate(ch, F.struct(off.alias("at"), none.alias("out")), lambda s, x: F.struct((s["at"] + x["gap"] + x["len"]).alias("at"), F.concat(s["out"], F.array(s["at"] + x["gap"])).alias("out")))["out"])
    return F.flatten(each)


def _hits(name: str, kind: str, base: bool, pieces: Column, found: Column, lists: Gazetteers, starts: Column | None = None) -> Column:
    """A struct for each match: kind, base, value, votes, length class and, with starts, its place."""

    def one(value: Column, i: Column) -> Column:
        before, after = F.right(F.get(pieces, i), F.lit(CONTEXT)), F.left(F.get(pieces, i + 1), F.lit(CONTEXT))
        fields = [F.lit(name).alias("pattern"), F.lit(kind).alias("kind"), F.lit(base).alias("base"), (valid(kind, value) if base else F.lit(True)).alias("valid")]
        fields += [v.cast("int").alias(voter) for voter, v in zip(VOTERS, votes(name, value, before, after, lists))]
        fields.append(F.least(F.floor(F.length(value) / 8), F.lit(3)).cast("int").alias("size"))
        if starts is not None:
            fields += [F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(value)).alias("end")]
        return F.struct(*fields)

    return F.transform(found, one)


def _with_matches(docs: DataFrame, text: Column, places: bool, lists: Gazetteers) -> tuple[DataFrame, list[Column]]:
    """docs with helper columns, and an array column of hits for each pattern."""
    known = patterns(lists)
    docs = docs.withColumn("__digits", text.rlike(DIGITS))
    docs = docs.withColumns({f"__may{k}": _may(text, F.col("__digits"), *p[4:]) for k, p in enumerate(known)})
    for k, p in enumerate(known):
        pieces, found = _matched(text, p[3], F.col(f"__may{k}"))
        docs = docs.withColumns({f"__pieces{k}": pieces, f"__found{k}": found})
    if places:
        docs = docs.withColumns({f"__starts{k}": F.when(F.size(f"__found{k}") > 0, _starts(F.col(f"__pieces{k}"), F.col(f"__found{k}"))) for k in range(len(known))})
    hits = [_hits(*p[:3], F.col(f"__pieces{k}"), F.col(f"__found{k}"), lists, F.col(f"__starts{k}") if places else None) for k, p in enumerate(known)]
    return docs, hits


class Kind:
    """What is known of the candidates of one pattern: the share that is personal data, how often each labeler is right
    when it votes, each labeler's share of a say, and the classifier's weights."""

    def __init__(self, prior: float, right: np.ndarray, share: np.ndarray):
        self.prior, self.rights, self.share, self.weights = prior, right, share, {}

    def posterior(self, votes: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of vote patterns by the label model, or by some of its labelers."""
        odds = self.share * np.log(self.rights / (1 - self.rights)) * (1 if of is None else of)
        return 1 / (1 + np.exp(-(np.log(self.prior / (1 - self.prior)) + votes @ odds)))

    @property
    def right(self) -> dict[str, float]:
        return dict(zip(VOTERS, self.rights.tolist()))


class Model:
    """A Kind for each pattern, and the gazetteers that they were learnt with."""

    def __init__(self, kinds: dict, lists: Gazetteers):
        self.kinds, self.lists = kinds, lists

    def probability(self, name: str, hit: Column) -> Column:
        weights = self.kinds[name].weights
        z = F.lit(weights["bias"])
        for (field, value), w in ((k, w) for k, w in weights.items() if k != "bias"):
            z = z + F.when(hit[field] == value, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def keeps(self, name: str, base: bool, hit: Column) -> Column:
        return hit["valid"] if base else self.probability(name, hit) >= THRESHOLD


def fit(docs: DataFrame, text_col: str = "text", lists: Gazetteers = Gazetteers()) -> Model:
    """Counts the vote patterns of all candidates and learns from the counts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows, hits = _with_matches(docs.select(text.alias("__text")), F.col("__text"), False, lists)
    flat = rows.select(F.explode(F.concat(*hits)).alias("h")).select("h.*").where("valid or not base or kind = 'card'")
    got = [r.asDict() for r in flat.groupBy("pattern", *VOTERS, "size").count().collect()]  # at most patterns x 3^5 x sizes rows
    return Model({name: _learn_kind([r for r in got if r["pattern"] == name], *TELLING.get(name, (YES, NO))) for name, *_ in PATTERNS}, lists)


def _shares(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each labeler's share of a say: labelers that say the same on nearly all candidates, and not always, have one."""
    if not len(n):
        return np.ones(len(VOTERS))
    varies = np.array([len(np.unique(v[:, j])) > 1 for j in range(len(VOTERS))])
    same = np.array([[n @ (v[:, j] == v[:, k]) >= SAME * n.sum() for k in range(len(VOTERS))] for j in range(len(VOTERS))])
    return 1 / np.maximum(1, (same & varies & varies[:, None]).sum(1))


def _learn_kind(patterns: list[dict], yes: float = YES, no: float = NO) -> Kind:
    v = np.array([[r[k] for k in VOTERS] for r in patterns], float).reshape(-1, len(VOTERS))
    n = np.array([r["count"] for r in patterns], float)
    right, wrong = (np.array([a] * 4 + [b]) for a, b in ((RIGHT, RIGHT_AROUND), (WRONG, WRONG_AROUND)))
    kind = Kind(yes / (yes + no), right / (right + wrong), _shares(v, n))
    rarer = np.minimum(n @ (v > 0), n @ (v < 0))
    both_ways = (rarer >= RARER) & (rarer >= RARER_SHARE * (n @ (v != 0)))

    def estimate(p: np.ndarray, of: np.ndarray) -> None:
        agree = np.array([n @ np.where(v[:, j] > 0, p, np.where(v[:, j] < 0, 1 - p, 0.0)) for j in range(len(VOTERS))])
        kind.rights = np.where(of, (agree + right) / (n @ (v != 0) + right + wrong), kind.rights)

    if (both_ways * kind.share).sum() >= ENOUGH:
        for _ in range(ROUNDS):
            p = kind.posterior(v, both_ways)
            before, kind.prior = kind.prior, float((n @ p + yes) / (n.sum() + yes + no))
            estimate(p, both_ways)
            if abs(kind.prior - before) < 1e-10:
                break
        estimate(kind.posterior(v, both_ways), ~both_ways)  # by what the others found, so that none confirms itself
    every = np.array(list(itertools.product((-1, 0, 1), repeat=len(VOTERS))), float)
    votes_, size = np.concatenate([v, np.repeat(every, 4, 0)]), np.concatenate([[r["size"] for r in patterns], np.tile(np.arange(4), len(every))])
    weight = np.concatenate([n / max(1.0, n.sum()) * min(n.sum(), 1e4), np.full(4 * len(every), UNSEEN)])
    target = kind.posterior(votes_)
    names = [(name, value) for name in VOTERS for value in (-1, 1)] + [("size", s) for s in range(4)]
    fields = {name: votes_[:, j] for j, name in enumerate(VOTERS)} | {"size": size}
    x = np.column_stack([np.ones(len(votes_)), *(fields[f] == value for f, value in names)])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 0.01 * np.eye(len(w)), x.T @ (weight * (target - q)) - 0.01 * w)
        w += step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    kind.weights = {"bias": float(w[0]), **{k: float(a) for k, a in zip(names, w[1:])}}
    return kind


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans (array of kind, base, start, end; by start, then kind as listed)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows, hits = _with_matches(docs.select(F.col(id_col), text.alias("__text")), F.col("__text"), True, model.lists)
    order = F.array(*[F.lit(k) for k in KINDS])
    slim = lambda h: F.struct(h["start"].alias("start"), F.array_position(order, h["kind"]).cast("int").alias("nth"), h["end"].alias("end"), h["kind"].alias("kind"), h["base"].alias("base"))
    kept = [F.transform(F.filter(h, functools.partial(model.keeps, name, base)), slim) for h, (name, _, base) in zip(hits, PATTERNS)]
    rows = rows.select(id_col, F.array_sort(F.concat(*kept[:4])).alias("__base"), F.array_sort(F.concat(*kept[4:])).alias("__loose"))
    # base spans in chunks with their reach, so that a loose span isn't compared with each of them
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("__base") - 1) / _CHUNK).cast("int")), lambda c: F.slice("__base", c * _CHUNK + 1, F.lit(_CHUNK)))
    chunks = F.transform(parts, lambda ch: F.struct(F.get(ch, F.lit(0))["start"].alias("start"), F.array_max(F.transform(ch, lambda b: b["end"])).alias("end"), ch.alias("own")))
    rows = rows.withColumn("__chunks", F.when((F.size("__base") > 0) & (F.size("__loose") > 0), chunks))
    meets = lambda s, b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    free = F.filter("__loose", lambda s, i: ~F.coalesce(F.exists("__chunks", lambda c: meets(s, c) & F.exists(c["own"], lambda b: meets(s, b))), F.lit(False)) & ((i == 0) | (s["start"] >= F.get(F.col("__loose"), i - 1)["end"])))
    return rows.select(id_col, F.array_sort(F.concat("__base", F.when(F.size("__loose") > 0, free).otherwise(F.col("__loose")))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans by kind, base_sha256 and spans of detect()'s rows."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _shown(name: str, kind: str, base: bool, model: Model):
    return lambda m, h: F.when(model.keeps(name, base, h), F.lit(f"[{kind.upper()}]")).otherwise(m)


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with every kept span of the text replaced by its kind in brackets; base patterns go first, in the order of the
    kinds, and loose ones last. A null text stays null."""
    own = f"c{docs.columns.index(text_col)}"
    rows = common.plain(docs)  # no name of docs meets a helper's
    kept = rows.columns
    rows = rows.withColumn("text", F.coalesce(F.col(own).cast("string"), F.lit("")))
    rows = rows.withColumn("digits", F.col("text").rlike(DIGITS))
    for name, kind, base, pattern, needs, strings, test in patterns(model.lists):
        rows = rows.withColumn("may", _may(F.col("text"), F.col("digits"), needs, strings, test))
        pieces, found = _matched(F.col("text"), pattern, F.col("may"))
        rows = rows.withColumns({"pieces": pieces, "found": found})
        hits = _hits(name, kind, base, F.col("pieces"), F.col("found"), model.lists)
        shown = F.zip_with("found", hits, _shown(name, kind, base, model))
        whole = F.array_join(F.zip_with("pieces", shown, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
        rows = rows.withColumn("text", F.when(F.size("found") > 0, whole).otherwise(F.col("text")))
    rows = rows.withColumn(own, F.when(F.col(own).isNotNull(), F.col("text")))
    return rows.select(*kept).toDF(*docs.columns)
