import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tidewell.llm import leakage, packing, residue


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# Packing

def texts(seed, n=400):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "value_handler", "Änderung", "x1", "zzz", "\n+  ", "  ", "日本", "🙂"])
    return [" ".join(word() for _ in range(int(rng.expovariate(1 / 60)))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_every_text_once(spark, name):
    data = [(k, t) for k, t in enumerate(texts(1) + ["", "a " * 5000, "x" * 3000, "\n" * 900])]
    df = spark.createDataFrame([(*r, "c") for r in data], "doc_id long, text string, container string").repartition(3)
    path = packing.TOKENIZER.rsplit("/", 1)[0] + "/" + name
    got = packing.pack_documents(df, 256, path).toPandas()
    count = packing.token_counter(path)
    joined = got.sort_values(["doc_id", "piece"]).groupby("doc_id").text.agg("".join).to_dict()
    assert joined == dict(data)
    assert count(got.text.tolist()) == got.n_tokens.tolist()
    fill = got.groupby("container").n_tokens.sum()
    assert fill.max() <= 256
    split = got[got.n_pieces > 1]
    assert all(count([dict(data)[i]])[0] > 256 for i in set(split.doc_id))
    assert fill.sum() / (256 * len(fill)) > 0.93


def test_best_fit_against_search():
    rng = random.Random(2)
    bins, plain = packing.OpenContainers(100), []
    for size in [rng.randrange(0, 101) for _ in range(3000)]:
        fits = [r for r in plain if r >= size]
        best = min(fits) if fits else None
        assert bins.tightest(size) == best
        bins.put(size)
        if best is not None:
            plain.remove(best)
        plain.append((100 if best is None else best) - size)
    assert sorted(plain) == sorted(r for r, own in enumerate(bins.at) for _ in own)


def test_a_split_is_packed_as_a_whole(spark, monkeypatch):
    """However many windows a split is read in, its texts are placed in order of falling size of the whole split."""
    monkeypatch.setattr(packing, "WINDOW_DOCS", 20)
    rng = random.Random(4)
    data = [(k, " a" * rng.randrange(0, 130)) for k in range(500)]
    got = packing.pack_documents(spark.createDataFrame(data, "doc_id long, text string").coalesce(1), 256).toPandas()
    assert dict(zip(got.doc_id, got.text)) == dict(data) and len(got) == 500
    bins, fill = packing.OpenContainers(256), {}
    for n in sorted(got.n_tokens.tolist(), reverse=True):
        k = bins.put(n)
        fill[k] = fill.get(k, 0) + n
    assert sorted(got.groupby("container").n_tokens.sum()) == sorted(fill.values())


def test_packing_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (None, "a b"), (2, "same"), (2, "same"), (3, "")], "doc_id long, text string").coalesce(1)
    got = rows(packing.pack_documents(df), "doc_id", "container", "n_tokens", "text")
    assert len(got) == 5 and [(c, n, t) for i, c, n, t in got if i == 1] == [(None, 0, None)]
    assert all(c is not None for i, c, _, _ in got if i != 1)
    assert packing.pack_documents(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(df, capacity=3)


# Leaks

def plain_leaks(docs, items):
    grams = {}
    for i, t in items:
        w = leakage.words_of(t)
        for k in range(len(w) - 9):
            grams.setdefault(tuple(w[k:k + 10]), set()).add((i, t))
    return sorted({(d, next(iter(grams[g]))[0]) for d, t in docs if t for w in [leakage.words_of(t)] for k in range(len(w) - 9) if len(grams.get(g := tuple(w[k:k + 10]), ())) == 1})


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("join", [False, True])
def test_leaks(spark, monkeypatch, seed, join):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)] + ["The", "of", "Ä1"]
    opening = " ".join(rng.choices(vocab, k=14))
    items = [(k, (opening + " " if k % 3 == 0 else "") + " ".join(rng.choices(vocab, k=rng.randrange(5, 60)))) for k in range(40)]
    items.append((77, "the the the the the the the the the the the the"))
    docs = []
    for d in range(300):
        w = rng.choices(vocab, k=rng.randrange(0, 80))
        if rng.random() < 0.5:
            own = items[rng.randrange(len(items))][1].split()
            k, n = rng.randrange(max(1, len(own) - 8)), rng.randrange(8, 14)
            w[rng.randrange(len(w) + 1):0] = own[k:k + n]
        docs.append((d, rng.choice([" ", "\n+ ", "_", ", "]).join(w).upper() if rng.random() < 0.3 else " ".join(w)))
    docs += [(1000, None), (1001, ""), (1002, "the " * 40), (1003, docs[5][1])]
    if join:
        monkeypatch.setattr(leakage, "MAX_ITEM_CHARS", 10)
    got = rows(leakage.find_leaks(spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "item_id")
    assert sorted(got) == plain_leaks(docs, items) and len(got) > 50


def test_index_of_many_items():
    """50,000 items: everything is found that an exact look at all passages finds, by an index of bounded size."""
    rng = random.Random(9)
    vocab = [f"w{k}" for k in range(30_000)]
    upto = list(accumulate(1 / (k + 2.7) for k in range(30_000)))  # as often as words of a language
    items = [(k, " ".join(rng.choices(vocab, cum_weights=upto, k=rng.randrange(12, 30)))) for k in range(50_000)]
    index = leakage.ItemIndex(items)
    assert index.nbytes < 200 << 20
    docs, true = [], []
    for d in range(400):
        w = rng.choices(vocab, cum_weights=upto, k=60)
        k = rng.randrange(50_000)
        own = items[k][1].split()
        at, n = rng.randrange(len(own) - 10), rng.choice([9, 10, 11])
        w[20:20] = own[at:at + n]
        docs.append(w)
        true.append((k, n))
    grams = {}
    for k, t in items:
        w = t.split()
        for j in range(len(w) - 9):
            grams.setdefault(tuple(w[j:j + 10]), set()).add(k)
    want = [sorted({next(iter(s)) for j in range(len(w) - 9) if len(s := grams.get(tuple(w[j:j + 10]), ())) == 1}) for w in docs]
    got = index.search_many(docs)
    assert got == want and sum(map(len, got)) > 200


def test_leaks_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert leakage.find_leaks(docs, none).count() == 0 and leakage.find_leaks(docs.limit(0), none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f g h i j"), (5, None), (6, ""), (7, "A-b_c.d e f g h i j"), (7, "A-b_c.d e f g h i j")], "item_id long, text string")
    assert rows(leakage.find_leaks(docs, odd), "doc_id", "item_id") == [(1, 7)]
    copies = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j")], "item_id long, text string")
    assert leakage.find_leaks(docs, copies).count() == 0


# Residue

HEAD = "commit 0123456789abcdef0123456789abcdef01234567\nAuthor: a.b <a.b@x.test>\nDate:   2011-01-01 00:00:00 +0000\n\n    "
DIFF = "\n\ndiff --git a/x.py b/x.py\nindex 1..2 100644\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,3 @@\n+def f():\n-    return 1"


@pytest.mark.parametrize("text,kind", [
    (HEAD + "{{ title }}\n\n    {{ body }}" + DIFF, "message"),
    ("From 0123456789abcdef by a.b\nSubject: [PATCH] fix(${SCOPE}): ${TITLE} ${WHY}\n---" + DIFF, "message"),
    ("Backport of <title> to the old branch\n\nReason: <reason>" + DIFF, "message"),
    ("[insert summary here]\n\n[describe what changed and why]" + DIFF, "message"),
    ("Lorem ipsum dolor sit amet\n\nconsectetur adipiscing elit" + DIFF, "message"),
    ("%s: update %s (%d files)" + DIFF, "message"),
    ("Add a limit\n\nYou need to turn on JavaScript to see this diff.", "diff"),
    (HEAD + "Add a limit\n\nFehler 404: Die Seite wurde nicht gefunden oder ist derzeit nicht erreichbar.", "diff"),
    ("From 0123456789abcdef by a.b\nSubject: [PATCH] Add a limit\n---\nPlease enable scripting\nin your browser settings.", "diff"),
    ("ACCESS DENIED. YOU LACK THE PERMISSION TO VIEW THIS RESOURCE (00AB12).", "text"),
    ("<html><head><title>503 Service Unavailable</title></head><body><h1>Service Unavailable</h1><hr>gateway 0a1b</body></html>", "text"),
    ("Too many requests. Try again later.", "text"),
    ("Your session has expired. Please log in.", "text"),
    (HEAD + "Stop the linter from flagging {{ name }} in mail templates" + DIFF, None),
    ("Reject commit messages that still hold <subject> or [insert summary here]\n\nUsers saw stale numbers." + DIFF, None),
    ("Show a friendlier page for 404 Not Found answers" + DIFF, None),
    ("Log 'Something went wrong' only once" + DIFF, None),
    ("Replace lorem ipsum in the demo page with a short help text" + DIFF, None),
    ("Add the notice that asks users to turn on JavaScript" + DIFF, None),
    ("Fix\n\ndiff --git a/x b/x\n@@ -1,1 +1,1 @@\n+Your session has ended. Sign in again to see this change.", None),
    ("fix", None), ("Merge branch 'x' into y", None), ("Release 1.2.3 [skip ci]", None), ("[bot] refresh lock file", None), ("Error handling for page reload" + DIFF, None),
    ("Fix\n\nBinary files a/x.png and b/x.png differ", None), ("", None), (None, None), (".", None), (HEAD, None),
])
def test_residue(text, kind):
    assert residue.residue_kind(text) == kind


# Wording that is in none of the tables.
UNSEEN_PAGES = """Please enable JavaScript to continue. | This page requires JavaScript. Please turn it on and refresh. | Your browser does not support JavaScript or it is disabled. | Hmm. We're having trouble finding that site.
The page could not be loaded. Try again. | 504 Gateway Timeout nginx | HTTP ERROR 500 | Sorry, this page isn't available. The link you followed may be broken, or the page may have been removed. | Oops! That page can't be found.
You have reached your API rate limit. Please wait 60 seconds. | We've detected unusual activity from your network. | Just a moment... Verifying you are human. This may take a few seconds. | We use cookies. Please accept cookies to continue.
Session timed out, please log in. | You don't have access to this repository. | Service temporarily down. Please come back later. | The diff is too large to be displayed. | An internal error occurred while rendering the page. | This content is not available in your region.
Connection timed out. The server took too long to respond. | Unable to load the patch. Check your network connection. | The database connection failed. Please contact the administrator. | Die Verbindung zum Server wurde unterbrochen. | Zugriff nicht erlaubt. Bitte melden Sie sich an. | JavaScript muss aktiviert sein.
Désolé, cette page n'existe plus. | Vous devez vous connecter pour voir cette page. | Ha ocurrido un error inesperado. Vuelva a intentarlo más tarde. | El servidor no responde. | Você precisa habilitar o JavaScript. | A página que procura não existe.
Si è verificato un errore. Riprova più tardi. | Pagina niet gevonden | Произошла ошибка сервера | JavaScript を有効にしてください | 页面未找到"""
UNSEEN_TEMPLATES = ["<<TITLE>>\n\n<<BODY>>", "%TITLE%: %BODY%", "$TITLE ($TICKET)\n\n$BODY", "TODO: describe the change", "Your commit message here", "[Title]\n\n[Description]", "{title}\n\n{body}", "Subject line here\n\nBody text here", "Type: ____\nScope: ____",
                    "short description\n\nlonger description", "asdf asdf asdf asdf", "foo bar baz qux foo", "null", "NaN: NaN", "<!-- Describe your changes -->", "«title» – «body»", "~TITLE~ ~BODY~", "@title@: @body@", "<Short summary of changes>",
                    "## What does this PR do?\n\n## Why?\n\n## Testing", "Please fill in a commit message", "# Please enter the commit message for your changes.\n# Lines starting with '#' will be ignored.", "{0}: {1}", "XXXX XXXX XX", "Insert description"]
REAL = """Handle 404 not found errors in the importer | Enable cookies on the login screen | Fix broken link on the start page | Server timeout is now 30 seconds | Show error page when session expired | Retry failed requests after timeout | Reject requests without session cookie
Improve error message for denied access | Increase rate limit for service accounts | Page cache: evict entries once expired | Return 503 during maintenance | Update title and description | Change summary line | Add description | Fix title | Use <T> in reader | Add None check | Handle null and undefined
Return null instead of None | Bump version from 1.2 to 1.3 | Support {{ name }} in templates | Fix ${HOME} expansion | Make %s formats safe | Add TODO list | fix fix fix | test test | Remove dead code | Describe the retry loop | Explain why the limit is needed
Fehler im Seitenindex beim Beenden | Corrige l'erreur de connexion | Error codes for the page footer | Proxy: do not open a connection without need | Allow build script with large files"""


def test_unseen_wording():
    pages = residue.phrases(UNSEEN_PAGES)
    assert [p for p in pages if residue.residue_kind("From 0123456789abcdef by a.b\nSubject: [PATCH] Add a limit\n---\n" + p) != "diff"] == []
    assert len([p for p in pages if residue.residue_kind(p) is None]) <= 3  # alone, too little is said
    assert [t for t in UNSEEN_TEMPLATES if residue.residue_kind(t + DIFF) != "message"] == []
    assert [t for t in residue.phrases(REAL) if residue.residue_kind(t) or residue.residue_kind(t + DIFF)] == []


def test_residue_of_any_length():
    long = "Tighten the merge of sorted runs while rows are kept in order.\n\n" * 200 + "\n\n".join(["The page could not be loaded.", "Please reload the page.", "You may have to sign in again."] * 200)
    assert residue.residue_kind(long) == "diff"
    assert residue.residue_kind("<why this change is needed " + "and what it does " * 40 + ">: {{ " + "x" * 500 + " }}" + DIFF) == "message"
    assert residue.residue_kind("Add a limit\n\ndiff --git a/x b/x\nindex 1..2 100644\n--- a/x\n+++ b/x\n<html><title>502 Bad Gateway</title></html>") == "diff"
    assert residue.residue_kind("{{" * 200_000) is None and residue.residue_kind("<" * 200_000 + "_" * 9 + " queue" * 9) is None


def test_residue_of_odd_rows(spark):
    df = spark.createDataFrame([(None, None, "x"), (1, "", "y"), (1, "Not Found", None), (1, "Not Found", None), (2, "word " * 300_000, "z")], "doc_id long, text string, residue string")
    got = residue.find_residue(df)
    assert got.columns == ["doc_id", "text", "residue"] and got.where("residue = 'text'").count() == 2 and got.count() == 5
    assert residue.without_residue(df).count() == 3 and residue.find_residue(df.limit(0)).count() == 0


def test_found_matches_the_tables(spark):
    from tidewell.llm.queries import p9_found
    from tidewell.sources.tables import table

    d = "/root/testdata/sf0.001"
    found = {r[0] for r in p9_found(spark, d).collect()}
    docs = table(spark, d, "documents")
    notices = {r[0] for r in docs.where(F.expr("text not like '%diff --git%' and (lower(text) like '%javascript%' or lower(text) like '%access denied%')")).select("doc_id").collect()}
    assert notices <= found
