"""Texts that broke a stage: long runs of white space, map columns past the size switches, rows without a declared language."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievemill import joins
from sievemill.llm import language_id, packing, shared
from sievemill.llm.language_id import LANGUAGES, identify, keep_identified, of_documents, trigram_cells, trigram_model
from sievemill.llm.mixing import mixed_documents
from sievemill.llm.packing import TokenIds, pack
from tests.llm.test_language_whole import OTHERS

BYTE = public_tokenizers.path("byte_bpe_50k.json")
#: Ten sentences a language that no model here has seen.
REAL = {
    "en": ["The old bridge was closed for repairs after the flood in spring", "She wrote three novels before anyone agreed to publish one of them", "Our neighbours keep bees and sell the honey at the market", "It is difficult to explain why prices rose so quickly last winter", "The teacher asked the class to bring a photograph of their family", "Most of the passengers were asleep when the train crossed the border", "He has been learning to play the piano since he was six years old", "Please send us your answer before the end of the month", "A new species of frog was discovered in the forests of the north", "They could not find the key, so they climbed through the window"],
    "de": ["Die alte Brücke wurde nach dem Hochwasser im Frühling gesperrt", "Sie schrieb drei Romane, bevor jemand einen davon drucken wollte", "Unsere Nachbarn halten Bienen und verkaufen den Honig auf dem Markt", "Es ist schwer zu erklären, warum die Preise im letzten Winter so schnell stiegen", "Die Lehrerin bat die Klasse, ein Foto ihrer Familie mitzubringen", "Die meisten Fahrgäste schliefen, als der Zug die Grenze überquerte", "Er lernt Klavier, seit er sechs Jahre alt ist", "Bitte schicken Sie uns Ihre Antwort vor dem Ende des Monats", "In den Wäldern des Nordens wurde eine neue Froschart entdeckt", "Sie konnten den Schlüssel nicht finden und stiegen durch das Fenster"],
    "fr": ["Le vieux pont a été fermé après les inondations du printemps", "Elle a écrit trois romans avant que quelqu'un accepte d'en publier un", "Nos voisins élèvent des abeilles et vendent le miel au marché", "Il est difficile d'expliquer pourquoi les prix ont augmenté si vite cet hiver", "La maîtresse a demandé à la classe d'apporter une photo de famille", "La plupart des voyageurs dormaient quand le train a passé la frontière", "Il apprend le piano depuis qu'il a six ans", "Merci de nous envoyer votre réponse avant la fin du mois", "Une nouvelle espèce de grenouille a été découverte dans les forêts du nord", "Ils ne trouvaient pas la clé et sont entrés par la fenêtre"],
    "es": ["El viejo puente se cerró después de las inundaciones de la primavera", "Ella escribió tres novelas antes de que alguien quisiera publicar una", "Nuestros vecinos crían abejas y venden la miel en el mercado", "Es difícil explicar por qué los precios subieron tan rápido el invierno pasado", "La maestra pidió a la clase que trajera una foto de su familia", "La mayoría de los viajeros dormían cuando el tren cruzó la frontera", "Aprende a tocar el piano desde que tenía seis años", "Por favor, envíenos su respuesta antes de fin de mes", "En los bosques del norte se descubrió una nueva especie de rana", "No encontraban la llave y entraron por la ventana"],
}


@pytest.mark.parametrize("blank", [" ", "\t", "\n", " \n\t　", " "])
def test_long_white_space(blank):
    library, own = Tokenizer.from_file(BYTE), TokenIds(BYTE)
    for n in (packing.LONG_RUN - 1, packing.LONG_RUN, packing.LONG_RUN + 1, 200_000):
        run = (blank * n)[:n]
        for text in (run, f"a{run}", f"{run}b", f"it's{run}b 12{run}", f"<|endoftext|>{run}<|endoftext|>x"):
            assert np.frombuffer(own.ids(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("blank", [" ", "\t", "\n", " \t\n\r"])
def test_pack_two_million_blanks(spark, blank):
    text = "left" + (blank * 2_000_000)[:2_000_000] + "right"
    rows = pack(spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string"), BYTE).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == len(Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids) + 1


def test_ranges_are_even_in_bytes(spark, monkeypatch):
    """A group of equal texts and very long ones among short ones: no range holds much more than its share."""
    monkeypatch.setattr(packing, "RANGE_BYTES", 1 << 16)
    rows = [(k, f"some words of text number {k}") for k in range(3_000)] + [(None, "the same words again and again") for _ in range(4_000)] + [(9_000 + k, f"w{k} " * 30_000) for k in range(4)]
    ids = shared.stored(packing.tokenized(spark.createDataFrame(rows, "doc_id long, text string"), BYTE), "t")
    held = [r.n for r in packing._ranged(ids).groupBy("range").agg(F.sum(F.octet_length("ids")).alias("n")).collect()]
    assert len(held) > 5 and max(held) <= 2.5 * (1 << 16)


def test_map_columns_past_the_switches(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"some words {k}", "en" if k % 3 else "xx", f"s{k}") for k in range(60)] + [(99, "12", "en", "s1"), (98, "...", None, None)], "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("tags", F.create_map(F.lit("a"), F.col("doc_id"))).withColumn("deep", F.array(F.struct(F.create_map(F.coalesce("source", F.lit("-")), F.lit(1)).alias("m"))))
    from sievemill.llm import mixing

    switches = [n for n in vars(mixing) if n.isupper() and "SOURCES" in n]
    for n in switches:
        monkeypatch.setattr(mixing, n, 0)
    monkeypatch.setattr(language_id, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "FEW_ROWS", 0)
    assert switches and mixed_documents(docs).columns == docs.columns and mixed_documents(docs).count() > 0
    assert {r.doc_id for r in keep_identified(docs).collect()} >= set(range(60)) - set(range(0, 60, 3)) and not {98, 99} & {r.doc_id for r in keep_identified(docs).collect()}


@pytest.mark.parametrize("declared", ["NULL", "concat(lang, '-XX')", "concat(upper(lang), '_gb')", "concat(' ', lang)", "''", "CASE WHEN lang = 'en' THEN 'en' END"])
def test_nothing_goes_for_want_of_a_declaration(spark, declared):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    left = keep_identified(docs.withColumn("lang", F.expr(declared)))
    assert left.count() == docs.count()


def test_real_prose_stays(spark):
    """Beside invented prose, with and without a declaration; what others declare and doesn't fit goes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    real = [(-1 - k, t, lang if k % 2 else None, "src0", len(t)) for k, (lang, t) in enumerate((lang, t) for lang, texts in REAL.items() for t in texts)]
    odd = [(-1000 - k, t, tag, "src0", len(t)) for k, (t, tag) in enumerate(zip(OTHERS, ("it", "pl", "ru-RU", "FI")))]
    left = {r.doc_id for r in keep_identified(docs.unionByName(spark.createDataFrame(real + odd, docs.schema))).where("doc_id < 0").collect()}
    assert left == {r[0] for r in real}


def test_real_prose_by_a_model_of_real_prose(spark):
    """Languages told right and kept, beside foreign texts that are not; the model is one of seeds alone."""
    none = spark.createDataFrame([], "id long, text string, declared string")
    model = trigram_model(none)
    rows = [(k, t, None, None, lang) for k, (lang, t) in enumerate((lang, t) for lang, texts in REAL.items() for t in texts)]
    table = spark.createDataFrame([(*r[:4], r[4]) for r in rows], "doc_id long, text string, lang string, source string, truth string")
    got = {r.id: r for r in identify(of_documents(table), model=model).collect()}
    kept = [got[r[0]].kept and got[r[0]].lang == r[4] for r in rows]
    assert sum(kept) >= 0.95 * len(rows)
    free = {r.id: r for r in identify(of_documents(table)).collect()}
    assert sum(free[r[0]].kept and free[r[0]].lang == r[4] for r in rows) >= 0.95 * len(rows)


def test_unknown_language_is_an_error(spark):
    with pytest.raises(ValueError, match="pt"):
        trigram_model(spark.createDataFrame([(1, "ola", "pt")], "id long, text string, declared string"), (*LANGUAGES, "pt"))
    assert trigram_cells is not None
