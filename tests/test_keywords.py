import re
from collections import defaultdict

from simsift.operators.keywords import STOPWORDS, rake_keywords


def rake_brute(text, stop=frozenset(STOPWORDS)):
    if text is None:
        return None
    toks = re.findall(r"\w+|[^\w\s]+", text.lower())
    phrases, cur = [], []
    for t in toks:
        if t in stop or not re.fullmatch(r"\w+", t):
            if cur:
                phrases.append(cur)
            cur = []
        else:
            cur.append(t)
    if cur:
        phrases.append(cur)
    freq, deg = defaultdict(int), defaultdict(int)
    for p in phrases:
        for w in p:
            freq[w] += 1
            deg[w] += len(p)
    scored = []
    for p in phrases:
        score = 0.0
        for w in p:                    # plain left fold (no compensated sum)
            score += deg[w] / freq[w]
        scored.append((score, " ".join(p)))
    scored.sort(reverse=True)
    return " ".join(s for _, s in scored)


TEXTS = [
    "Compatibility of systems of linear constraints over the set of natural numbers. "
    "Criteria of compatibility of a system of linear Diophantine equations, strict "
    "inequations, and nonstrict inequations are considered.",
    "Intro to Calculus: limits, derivatives; limits again -- and integrals!",
    "the of and",
    "",
    None,
    "Étude des équations différentielles: équations linéaires et systèmes.",
    "repeat phrase here. repeat phrase here. other words",
]


def test_rake_matches_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, t string")
    got = {r.id: r.keywords for r in rake_keywords(df, "t", "id").collect()}
    assert got == {i: rake_brute(t) for i, t in enumerate(TEXTS)}
