"""What headers and questions speak of: aliases of concepts found in names and texts, as columns.

All runs of up to three words are cut from a text's folded form and from its Latin one, and met with the aliases by one hash set: a text costs its
length, whatever the number of aliases, and no row leaves its task.  A null text speaks of nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions import text

# The aliases of each concept, in the order in which they count; an alias means the first concept that has it.
VOCABULARY = {
    "revenue": ["revenue", "rev", "turnover", "sales", "оборот", "оборота", "оборотът", "приходи", "приход", "приходите"],
    "net_revenue": ["net revenue", "net sales", "net turnover", "нетен оборот", "нетния оборот", "нетният оборот", "чисти приходи", "нетни приходи"],
    "expenses": ["expenses", "costs", "cost", "spend", "разходи", "разход", "разходите"],
    "margin": ["margin", "gross margin", "марж", "маржа", "надценка"],
    "amount": ["amount", "value", "сума", "стойност"],
    "quantity": ["quantity", "qty", "units", "количество", "количеството", "бройки"],
    "price": ["price", "unit price", "цена", "цената", "единична цена"],
    "date": ["date", "дата", "invoice date", "transaction date", "период", "period", "дата на фактура"],
    "due_date": ["due date", "deadline", "падеж", "краен срок", "срок", "дата на плащане", "payment date"],
    "customer": ["customer", "customers", "client", "clients", "клиент", "клиенти", "клиента", "клиентите", "контрагент", "купувач"],
    "region": ["region", "regions", "area", "регион", "региона", "региони", "регионите", "район", "област"],
    "product": ["product", "products", "item", "продукт", "продукти", "артикул", "стока"],
    "invoice": ["invoice", "invoices", "фактура", "фактури", "фактурите", "invoice number", "номер на фактура"],
    "paid": ["paid", "платено", "платена", "is paid"],
    "forecast": ["forecast", "прогноза", "план", "plan", "budget", "бюджет"],
    "actual": ["actual", "actuals", "факт", "отчет"],
    "identifier": ["id", "no", "number", "номер", "код", "code"],
}
# Asking for one of these asks for its refinements as well, so that nothing is picked silently.
FAMILIES = {"revenue": ["revenue", "net_revenue"], "date": ["date", "due_date"]}
# Concepts that only a column of numbers can hold.
MONETARY = ("revenue", "net_revenue", "expenses", "amount", "margin", "quantity", "price")


def latin(plain: str) -> str:
    return "".join(text.CYRILLIC.get(c, c) for c in plain)


#: Each form of an alias, as it is and in Latin letters, and its concept.
FORMS: dict[str, str] = {}
for _concept, _aliases in VOCABULARY.items():
    for _alias in _aliases:
        for _form in (_alias, latin(_alias)):
            FORMS.setdefault(_form, _concept)
LONGEST = max(len(f.split()) for f in FORMS)
#: For each form, those with more words around it.
WIDER = {f: [g for g in FORMS if g != f and f" {f} " in f" {g} "] for f in FORMS}
_PLACE = {f: i for i, f in enumerate(sorted(FORMS, key=len, reverse=True))}


def _lookup(of: dict) -> Column:
    return F.create_map(*[x if isinstance(x, Column) else F.lit(x) for pair in of.items() for x in pair])


def _runs(words: Column, k: int) -> Column:
    cut = F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(F.size(words) >= k, cut).otherwise(F.array().cast("array<string>"))


def forms(c: Column) -> Column:
    """A name folded without punctuation, and the same in Latin letters; the empty name has none."""
    plain = text.normalized(c)
    return F.array_distinct(F.filter(F.array(plain, text.transliterated(plain)), lambda f: f != ""))


def _found(c: Column) -> Column:
    """The aliases in ``c``, as whole words."""
    words = F.transform(forms(c), lambda f: F.split(f, " "))
    cut = F.flatten(F.transform(words, lambda w: F.concat(*[_runs(w, k) for k in range(1, LONGEST + 1)])))
    return F.array_intersect(cut, F.array(*map(F.lit, FORMS)))


def of_name(c: Column) -> Column:
    """All concepts of a column's name, sorted."""
    known = _lookup(FORMS)
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(_found(c), lambda f: known[f]))), F.array().cast("array<string>"))


def of_text(c: Column) -> Column:
    """The concepts that a text speaks of, longest alias first; an alias inside a longer one that is there as well does not count."""
    known, place, wider = _lookup(FORMS), _lookup(_PLACE), _lookup({f: F.array(*map(F.lit, w)) for f, w in WIDER.items() if w})
    # The found aliases are bound to a variable, so that they are found once.
    kept = F.flatten(F.transform(F.array(_found(c)), lambda all_: F.filter(all_, lambda f: ~F.coalesce(F.arrays_overlap(wider[f], all_), F.lit(False)))))
    order = F.array_sort(F.transform(kept, lambda f: F.struct(place[f].alias("place"), known[f].alias("concept"))))
    return F.coalesce(F.array_distinct(F.transform(order, lambda x: x["concept"])), F.array().cast("array<string>"))


def wanted(c: Column) -> Column:
    """The concepts whose columns answer a question: those that it speaks of, with their refinements."""
    more = _lookup({k: F.array(*map(F.lit, v)) for k, v in FAMILIES.items()})
    return F.array_distinct(F.flatten(F.transform(of_text(c), lambda x: F.coalesce(more[x], F.array(x)))))
