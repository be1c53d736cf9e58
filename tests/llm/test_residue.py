from zlib import crc32

import numpy as np
import pyarrow.parquet as pq

from tidemark.llm import residue as module
from tidemark.llm.residue import EXEMPLARS, NO_PLACEHOLDERS, PLACEHOLDERS, SLOTS, Index, Notations, residue, tokens

NEWS = "Selling costs were $555 million, up 13.4%, on new distribution agreements and a larger sales force in the coastal business. The effective tax rate was 4.4%, compared with 42.8% a year earlier."
BAD = {
    "error": "404 Not Found\n\nThe page you asked for could not be found on tapewire.example. It may have been moved or removed.",
    "headline": "Halxano Group: backlog lifts dividend\n\nVeuillez activer JavaScript et les cookies pour poursuivre votre lecture.",
    "footer": "SUBHEADING PLACEHOLDER. YOUR HEADLINE GOES HERE.\n\nHome | Markets | Contact",
    "lorem": "Lorem ipsum duisa nulla velit duisa quisno dolora aliqa dolora. Enimva commod exerci pariar ipsum nisi aliqa.",
    "repeated": "foo " * 40,
    "stub": "Halnedyne Robotics: recall plant\n\nRevenue: to be completed\nCatalysts: n/a\nGuidance: tbc\nOutlook: -\nRisks: TBD",
    "mustache": NEWS + " Revenue rose {{ pct_change }} to the plan.",
    "blank": NEWS + " The ________ report is a catalyst.",
    "todo": NEWS + " Shares moved TODO: margin on Monday.",
}
GOOD = {
    "news": NEWS,
    "mention": NEWS + " A reviewer found that a draft deck still carried lorem ipsum on one slide; the published version was corrected the same day.",
    "explains": "The alert body is rendered from a template in which {{ run_date }} stands for the trading day; the renderer fills it before the message is sent. " + NEWS,
    "guide": "In our naming guide ${TICKER} marks a shell variable and %s a format slot; neither may appear in published notes.",
    "set": NEWS + " We define the indicator as f(x) in {0, 1} and weight it by [w1, w2]; see note [3] [sic].",
    "rule": NEWS + "\nSegment table\n____________________\nNorth   $892.62 million",
    "json": NEWS + ' The config reads {"stage": "scanner", "limit": 67} and has not changed.',
    "status": NEWS + " The vendor endpoint answered 404 for 39 tickers on Saturday, so the loader fell back to the cached closes.",
}


def test_labelled_cases(spark):
    rows = [(k, t, "c") for k, t in {**BAD, **GOOD}.items()] + [("null", None, "c"), ("empty", "", "c"), ("blank lines", " \n\n ", "c"), ("symbols", "--- ***", "c"), ("long", (NEWS + " ") * 400, "c"), ("error", BAD["error"], "c")]
    rows += [(f"n{i}", NEWS.replace("coastal", f"coastal{i}"), "c") for i in range(100)]
    got = [r.k for r in residue(spark.createDataFrame(rows, "k string, text string, coverage string"), key="k", text="text").collect()]
    assert set(got) == set(BAD) and got.count("error") == 2


def test_short_residue_before_furniture(spark):
    bad = {
        "form": "Risks: TBD\nRevenue: tbc\nCatalysts: n/a\nGuidance: to be completed\nOutlook: TBD\n\n(c) All rights reserved.",
        "error": "404 Not Found\n\nHome | Markets | Contact",
        "below headline": "Halnedyne Robotics: recall plant\n\nRisks: TBD\nRevenue: tbc\nOutlook: TBD\n\nMenu Search Log in",
    }
    good = {"headline": "Halnedyne Robotics recalls plant\n\nHome | Markets | Contact", "status": "404 Not Found\n\n" + NEWS}
    rows = [*bad.items(), *good.items(), *((f"n{i}", NEWS.replace("coastal", f"coastal{i}")) for i in range(100))]
    got = {r.k for r in residue(spark.createDataFrame(rows, "k string, text string"), key="k", text="text").collect()}
    assert got == set(bad)


def test_half_residue_beside_rare_words():
    index = Index(np.zeros(SLOTS, np.int64), 100_000)
    for w in ("foo", "the", "page"):
        index.df[crc32(w.encode()) & (SLOTS - 1)] = 90_000
    rare = " ".join("qz" + "".join(chr(97 + int(d)) for d in str(i)) for i in range(40))
    assert index.is_residue("foo " * 60 + rare)[0]
    assert index.is_residue("the page " * 30 + rare)[0] and not index.is_residue("the page " * 15 + rare)[0]


def test_empty(spark):
    assert residue(spark.createDataFrame([], "k string, text string"), key="k", text="text").count() == 0


# texts worded apart from the exemplars
HELD_OUT = {
    "error": [
        "We're sorry, but the page you were looking for doesn't exist. You may have mistyped the address or the page may have moved.",
        "HTTP Status 500 - Internal Server Error. The server encountered an unexpected condition that prevented it from fulfilling the request.",
        "Error 503 Backend fetch failed. Guru Meditation: XID: 98311. Varnish cache server",
        "Hmm. We're having trouble finding that site. We can't connect to the server. Check your network connection and try again later.",
        "You do not have access to this page. Please contact your administrator if you believe this is an error.",
        "The story you requested has been removed or is no longer available on our site.",
        "Die von Ihnen aufgerufene Seite existiert leider nicht mehr. Bitte kehren Sie zur Startseite zurück.",
        "Cette page n'est plus disponible. Veuillez vérifier l'adresse ou revenir à la page d'accueil.",
        "Lo sentimos, la página que busca no está disponible o ha sido eliminada.",
        "File \"/srv/app/views.py\", line 88, in render\n    raise ValueError(\"bad state\")\nValueError: bad state",
        "Rate limit exceeded. You have made too many requests; please wait a few minutes and try again.",
    ],
    "script": [
        "Sorry, this site needs JavaScript. Please turn it on in your browser settings and reload the page.",
        "Your browser has JavaScript disabled. Enable it to use this application.",
        "Please complete the security check to access the site and prove you are human.",
        "Bitte schalten Sie JavaScript ein, um diese Seite zu nutzen.",
        "Pour afficher cette page, JavaScript doit être activé dans votre navigateur.",
        "We noticed that you use an ad blocker. Please turn it off and refresh the page to read on.",
    ],
    "filler": [
        "Consectetur adipiscing dolor veniam. Nostrud ullamco laboris aliquip commodo, dolore magna tempor incididunt. Excepteur occaecat mollit.",
        "Add your text here. This is a sample paragraph; click to edit it and write something about your business.",
        "This section is coming soon. We are still working on its content, so please check back later.",
        "Summary: TBD\nBackground: to be added\nConclusion: tbc\nNext steps: pending",
    ],
}
CLEAN = [
    "The company said that an outage of its servers on Monday delayed the release of quarterly figures, and that no customer data was lost.",
    "Our web team replaced the old error page last month; visitors who follow a broken link now find a search box and the latest stories.",
    "Management could not find a buyer for the unit and will close the site, which is no longer profitable, by the end of the year.",
    "El servicio de pagos creció un doce por ciento y la empresa espera que el margen mejore en la segunda mitad del año.",
    "The browser vendor will disable third-party cookies in the next release, which analysts expect to weigh on ad networks.",
    "Please see note 4 for a description of the pension plan, which was amended and is described in the annual report.",
]


def corpus_index(small, exemplars=None):
    """An index with the word frequencies of the test table."""
    df, texts = np.zeros(SLOTS, np.int64), pq.read_table(f"{small}/documents.parquet", columns=["text"]).column(0).drop_null().to_pylist()
    for t in texts:
        for w in set(tokens(t)):
            df[crc32(w.encode()) & (SLOTS - 1)] += 1
    return Index(df, len(texts), exemplars)


def test_held_out_wordings(small):
    index = corpus_index(small)
    texts = [x for xs in HELD_OUT.values() for x in xs]
    found = sum(index.is_residue(x)[0] for x in texts)
    assert found >= 0.9 * len(texts) and not any(index.is_residue(x)[0] for x in CLEAN)
    assert not {x for xs in EXEMPLARS.values() for x in xs} & set(texts)


def test_site_names_and_server_signatures_are_furniture(small):
    index = corpus_index(small)
    assert all(index.is_residue(x)[0] for x in ("404 Not Found\nApache/2.4.41 (Ubuntu)", "503 Service Unavailable\nlighttpd/1.4.59\n\nnews.site.example", "504 Gateway Time-out\nquux/9.1"))
    assert not index.is_residue("The parser moved from libfoo/2.1 to libfoo/2.3, which lifted throughput by a third in the nightly run.")[0]


def test_exemplars_left_out(small):
    texts = [x for xs in HELD_OUT.values() for x in xs]
    found = []
    for fold in range(4):
        kept = {label: [x for i, x in enumerate(xs) if i % 4 != fold] for label, xs in EXEMPLARS.items()}
        index = corpus_index(small, kept)
        found.append(sum(index.is_residue(x)[0] for x in texts) / len(texts))
        assert not any(index.is_residue(x)[0] for x in CLEAN)
    assert sum(found) / len(found) >= 0.8


def test_notations_are_told_by_exemplars():
    of = Notations()
    held = {x: module._SPAN.search(x).group() for x in PLACEHOLDERS + NO_PLACEHOLDERS}
    assert all(of.is_placeholder(held[x]) for x in PLACEHOLDERS) and not any(of.is_placeholder(held[x]) for x in NO_PLACEHOLDERS)
    assert all(map(of.is_placeholder, ["{{ Order_No }}", "${shop.total}", "[CLIENT ADDRESS]", "[insert closing date]", "«Strasse»", "<%= total %>", "%(price)s", "&lt;client&gt;", "{3}"]))
    assert not any(map(of.is_placeholder, ["[emphasis added]", "[7]", "{0, 1}", "<div>", "[w1, w2]", "{\"stage\": 1}", "&lt;td&gt;"]))
