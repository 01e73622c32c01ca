"""Secrets in text: character Markov models of random strings and of ordinary identifiers, compared by likelihood."""

from __future__ import annotations

import base64
import functools
import math
import random
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, place, plain, slices

SCHEMA = "doc_id bigint, start bigint, end bigint, ratio double"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())])
#: By default a secret's fewest characters.
LEAST = 16


@functools.lru_cache(16)
def runs(least: int, also: str) -> re.Pattern:
    """The runs that can hold a secret: whole, or as a stretch of a path or a name."""
    one = rf"[A-Za-z0-9+/_\-{re.escape(also)}]"
    return re.compile(rf"(?<!{one}){one}{{{least},}}={{0,2}}")


TOKEN = runs(LEAST, "")
#: What parts the words of a path or a name.
_PARTS = "/_-"
_LETTER, _DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
_INDEX = np.full(256, len(_ALPHABET), np.int64)
_INDEX[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(len(_ALPHABET))
_SIZE = len(_ALPHABET) + 1

_NOUNS = """
account action address agent alarm alert amount analysis answer archive argument array article asset attribute author average balance batch block body border bottom branch bridge
broker browser bucket budget buffer build button cache calendar callback campaign cancel canvas capacity caption card cart category center chain change channel chapter character
charge chart check child choice circle city class client clock cloud cluster code collection color column command comment commit company component config connection console contact
container content context control cookie copy corner counter country course cover credit currency current cursor customer data database date debug decision default delete delivery
demand department deposit description design detail device dialog digest dimension direction directory discount display distance document domain download draft driver duration
editor effect element email employee empty enable encoder end engine entry environment error event example exception exchange export expression extension factor failure feature
feedback field figure file filter final finance first flag folder font footer force foreign format forward frame frequency function future gallery gateway general global grade graph
grid group growth guide handler hash header health height help hidden history holder home host hour icon identifier image import index info input insert instance integer interface
internal interval invoice issue item iterator job join journal key keyboard label language last latest layer layout leader length letter level library license limit line link list
loader local location lock logger login machine mail main manager mapping margin market master matrix maximum measure media member memory menu merge message method metric minimum
mobile mode model module money monitor month mouse name network news node normal note number object offer office offset operation option order origin output owner package page panel
parameter parent parser part partition password path pattern payment percent period permission person phone picture pixel place plan platform player plugin point policy pool port
position power prefix price print private process product profile program project property protocol provider proxy public purchase quality quantity query queue quick quote random
range rate reader reason receiver record region register relation release remote render replace report request reset resource response result return review right role root route row
rule sample scale schedule schema scope score screen script search season second section security segment select sender sequence series server service session setting shadow shape
share sheet shift shop signal signature simple single size slice slot socket source space special speed stack stage standard start state static status step stock storage store stream
street string structure student style subject submit subscription suffix summary supplier support switch symbol system table target task team template term test text theme thread
threshold ticket time title token tool top topic total tracking trade traffic transaction transfer transform tree trigger type unit update upload user utility validation value variable
vector vendor version video view visible volume warning watch weather week weight widget width window word worker writer year zone
""".split()  # fmt: skip
_OTHERS = """
abteilung anmeldung antwort arbeit aufgabe ausgabe auswertung bearbeitung bedingung benutzer berechnung bereich beschreibung bestellung bezeichnung datei datenbank eingabe einstellung
entwicklung ergebnis fehler fenster freigabe geschichte gesellschaft gleichung grundlage hauptseite hinweis kennung konto kunde lieferung meldung mitglied nachricht pflicht pruefung
rechnung schaltung schluessel schnittstelle sicherheit sprache steuerung suche tabelle uebersicht umgebung verarbeitung verbindung verein verfahren verkehr versicherung verwaltung
vorlage vorschau werkzeug wirtschaft zahlung zeichen zugang zusammenfassung zustand adresse affichage ajout annuaire appareil article bibliotheque bouton cadre chaine client
commande compteur compte connexion couleur demande developpement dossier echange ecran element emplacement enregistrement entreprise erreur espace etat evenement fenetre fichier
fonction gestion historique imprimante langue largeur liste livraison logiciel longueur materiau message modele montant niveau nombre objet outil paiement panneau parametre projet
quantite recherche reponse reseau resultat serveur session societe souhait tableau travail utilisateur valeur vitesse actualizar administracion ajuste aplicacion archivo ayuda busqueda
cadena cantidad carpeta cliente codigo comentario compra conexion configuracion contrasena cuenta descripcion direccion documento empresa entrada escritorio estado etiqueta factura fecha
funcion gestor grupo herramienta historial idioma imagen informacion lectura lista mensaje nombre numero objeto opcion pagina pantalla pedido producto proyecto respuesta resultado
seguridad servicio sistema solicitud tabla tamano tarea teclado usuario valor ventana and are because between both but could each even from have into more most much only other over same
should some such than that their them then there these they thing this those through under very was were what when where which while will with would the for not you all can her one our
out day get has him his how its may new now old see two way who did yes let put say she too use ing tion ness ment able ible heit keit ung lich schaft chen eau eux oux aient ement cion
dad mente ando iendo ado ida
""".split()  # fmt: skip


class Model(NamedTuple):
    """``table[a, b, c]``: the log-likelihood ratio of c after a and b, random against ordinary; see ``train`` for the rest."""

    table: np.ndarray
    threshold: float
    doubt: float
    least: int = LEAST
    also: str = ""

    def ratios(self, token: str) -> np.ndarray:
        """The share of each character in the ratio of the whole."""
        x = _INDEX[np.frombuffer(token.encode("ascii", "replace"), np.uint8)]
        y = np.concatenate(([_SIZE - 1, _SIZE - 1], x))
        return self.table[y[:-2], y[1:-1], y[2:]]

    def ratio(self, token: str) -> float:
        return float(self.ratios(token).sum())

    def _secret(self, token: str, ratio: float) -> bool:
        return bool(_LETTER.search(token)) and ratio >= self.threshold + self.doubt * (not _DIGIT.search(token))

    def stretches(self, token: str) -> list[tuple[int, int, float]]:
        """Start, end and ratio of each secret of a run: the run itself or, where other characters outweigh it, its best stretches.

        The best stretch is the one of ``least`` characters or more with the largest sum; what lies before and after it is searched
        in the same way. As the best of so many, it has to reach the logarithm of the run's length more. It is then widened to the next
        separators, since the ends of a key may read as ordinary.
        """
        least, parts = self.least, _PARTS + self.also
        each = self.ratios(token).astype(float)
        if self._secret(token, whole := float(each.sum())):
            return [(0, len(token), whole)]
        run = np.concatenate(([0.0], np.cumsum(each)))
        more = math.log(len(token))
        out, todo = [], [(0, len(token))]
        while todo:
            low, high = todo.pop()
            if high - low < least:
                continue
            lowest = np.minimum.accumulate(run[low : high - least + 1])
            gain = run[low + least : high + 1] - lowest
            if gain.max() < self.threshold + more:
                continue
            stop = low + least + int(gain.argmax())
            start = low + int(run[low : stop - least + 1].argmin())
            if self._secret(token[start:stop], float(run[stop] - run[start]) - more):
                start = max([low, *(token.rfind(c, low, start) + 1 for c in parts)])
                stop = min([high, *(k for c in parts if (k := token.find(c, stop, high)) >= 0)])
                out.append((start, stop, float(run[stop] - run[start])))
            todo += [(low, start), (stop, high)]
        return sorted(out)

    def find(self, text: str | None) -> list[tuple[int, int, float]]:
        """Start, end and ratio of each secret of a text, in order."""
        return [(m.start() + a, m.start() + b, r) for m in runs(self.least, self.also).finditer(text or "") for a, b, r in self.stretches(m.group())]

    def redact(self, text: str | None, mark: str) -> str | None:
        if not text or not (found := self.find(text)):
            return text
        parts, at = [], 0
        for start, end, _ in found:
            parts += [text[at:start], mark]
            at = end
        return "".join((*parts, text[at:]))


def labelled(n: int = 6000, seed: int = 11, also: str = "") -> Iterator[tuple[str, bool]]:
    """Labelled samples: random strings in the alphabets that keys are written in (true), and ordinary names (false).

    With the marks of ``also``, strings that hold them besides, and names that are parted by them.
    """
    rng = random.Random(seed)
    hexa, b32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    b62 = _ALPHABET[:62]
    for k in range(n):
        size = rng.choice((16, 18, 20, 24, 32, 36, 40, 48, 64))
        kind = k % 7
        if kind == 0:
            yield "".join(rng.choices(hexa, k=size)), True
        elif kind == 1:
            yield "".join(rng.choices(hexa.upper(), k=size)), True
        elif kind == 2:
            yield rng.choice(("", "AKIA", "ASIA")) + "".join(rng.choices(b32, k=size)), True
        elif kind == 3:
            yield base64.b64encode(rng.randbytes(size)).decode(), True
        elif kind == 4:
            yield base64.urlsafe_b64encode(rng.randbytes(size)).decode().rstrip("="), True
        elif kind == 5:
            yield rng.choice(("ghp_", "sk-", "pk_live_", "xoxb-", "glpat-", "")) + "".join(rng.choices(b62, k=size)), True
        else:
            yield "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=size)), True
    words = _NOUNS + _OTHERS
    for k in range(4 * n):
        w = rng.choices(words, k=rng.randint(2, 5))
        number = rng.choice(("", "", str(rng.randrange(10)), str(rng.randrange(100)), str(rng.randint(1990, 2030)), str(rng.randrange(10**6))))
        kind = k % 10
        if kind == 0:
            out = "_".join([*w, *([number] if number else [])])
        elif kind == 1:
            out = "-".join([*w, *([number] if number else [])])
        elif kind == 2:
            out = w[0] + "".join(map(str.title, w[1:])) + number
        elif kind == 3:
            out = "".join(map(str.title, w)) + number
        elif kind == 4:
            out = "_".join(w).upper() + ("_" + number if number else "")
        elif kind == 5:
            out = "/".join(w) + ("/" + number if number else "")
        elif kind == 6:
            out = "".join(w)
        elif kind == 7:
            out = "".join(w).title()
        elif kind == 8:
            out = "".join(w).upper()
        else:
            day = f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
            out = rng.choice((f"{day}-{w[0]}-{w[1]}", f"{w[0]}-{day}", f"{day}T{rng.randrange(24):02}-{rng.randrange(60):02}", f"/{day.replace('-', '/')}/{w[0]}", f"v{rng.randrange(10)}-{rng.randrange(99)}-{rng.randrange(99)}-{w[0]}", "-" * rng.randint(16, 40), "_" * rng.randint(16, 40) + w[0], "=" * 3 + w[0] * 5, rng.choice("abxz") * rng.randint(16, 30)))
        yield out, False
    for _ in range(n * bool(also)):
        yield "".join(rng.choices(b62 + also * 2, k=rng.randint(8, 24))), True
        for joint in (rng.choice(also), rng.choice(also) + rng.choice(("", "/", "//", "_"))):
            yield joint.join(rng.choices(words, k=rng.randint(2, 5))) + rng.choice(("", also[0], rng.choice(also), str(rng.randrange(100)))), False


def _smoothed(texts: Iterable[str], weight: float) -> np.ndarray:
    """Log chances of each character after the two before, backed by those after one and by those after none."""
    three = np.zeros((_SIZE, _SIZE, _SIZE))
    for t in texts:
        x = _INDEX[np.frombuffer(t.encode("ascii", "replace"), np.uint8)]
        y = np.concatenate(([_SIZE - 1, _SIZE - 1], x))
        np.add.at(three, (y[:-2], y[1:-1], y[2:]), 1)
    two = three.sum(0)
    one = two.sum(0)
    p1 = (one + 0.5) / (one.sum() + 0.5 * _SIZE)
    p2 = (two + weight * p1) / (two.sum(1, keepdims=True) + weight)
    p3 = (three + weight * p2) / (three.sum(2, keepdims=True) + weight)
    return np.log(p3)


def train(samples: Iterable[tuple[str, bool]] | None = None, *, weight: float = 20.0, threshold: float = 8.0, doubt: float = 24.0, least: int = LEAST, also: str = "") -> Model:
    """Models of the true and the false samples (by default ``labelled(also=also)``), as one table of differences.

    A candidate has ``least`` characters or more: letters, digits, ``+ / _ -`` and the ASCII marks of ``also``. The defaults are for keys. Passwords are
    shorter and hold other marks: ``least=8, also="!@#$%&.:~"`` finds such, at the price of more ordinary text that looks random.

    A token is a secret if its ratio is at least ``threshold``: that many nats, so e**8 to one. One without a digit may be
    a word of a language that the samples don't hold, and has to reach ``doubt`` more. A stretch of a longer run: see ``Model.stretches``.
    """
    random_, ordinary = [], []
    for text, secret in labelled(also=also) if samples is None else samples:
        if text:
            (random_ if secret else ordinary).append(text)
    if not random_ or not ordinary:
        raise ValueError("samples of both kinds are needed")
    return Model((_smoothed(random_, weight) - _smoothed(ordinary, weight)).astype(np.float32), threshold, doubt, least, also)


def scan(docs: DataFrame, model: Model | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``start``, ``end`` and ``ratio`` of every secret: a run of key characters that reads as random, or such a stretch of a longer run.

    A secret has 16 characters at least, and those of the model's alphabet only; both are parameters of ``train``.

    The secret itself is not repeated in the result. Each text is read once, whole; nothing is shuffled. Runs without a letter, such as card
    and telephone numbers, are none. Null and empty texts hold none. A null id stays null; repeated rows have theirs as often as they occur.
    An empty table gives no rows. Other columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [(doc, *hit) for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True) for hit in sent.value.find(text)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW)], schema=ARROW)

    return plain(docs, id=id_col, text=text_col).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, model: Model | None = None, *, text_col: str = "text", size_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with ``mark`` in place of each secret; ``size_col``, where there is one, is counted anew for changed texts. No row goes.

    Null and empty texts stay as they are, and a null size of an unchanged text stays null; repeated rows stay repeated, and an empty table gives
    no rows. All columns stay. What counts as a secret is said in ``scan``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or train())

    @F.arrow_udf("string")
    def clean(text: pa.Array) -> pa.Array:
        return pa.array([sent.value.redact(t, mark) for t in text.to_pylist()], pa.string())

    at = place(docs, text_col)
    size = place(docs, size_col) if size_col and size_col.lower() in map(str.lower, docs.columns) else None
    old = F.col(f"c{at}").cast("string")
    held = numbered(docs).withColumn("__clean", clean(old))
    columns = [
        F.col("__clean") if k == at
        else F.when(F.col("__clean") != old, F.length("__clean")).otherwise(F.col(f"c{k}")).cast(kind) if k == size
        else F.col(f"c{k}")
        for k, (_, kind) in enumerate(docs.dtypes)
    ]
    return held.select(*columns).toDF(*docs.columns)
