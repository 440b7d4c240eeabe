"""Signs of template residue, filler, error pages and script notices in a text, by exact rules.

A template field counts in running text only: not in code, not where a text writes about fields. A text consists
mostly of filler, of an error page or of a script notice when more than half of its characters outside of page
furniture lie in such passages.
"""

from __future__ import annotations

import bisect
import re
from functools import cache

from papyra.llm.prefilter import Rules, fold

# ---------------------------------------------------------------- template fields

_IDENT = r"[A-Za-z_À-ÿ][\w.À-ÿ-]*"
_FIELD = re.compile(
    rf"""\{{\{{[\#/^>&!]?\s*{_IDENT}(?:\s+[^{{}}\n]{{1,60}})?\s*\}}\}} | \{{%-?\s*\w+[^%\n]{{0,80}}%\}} | <%[=\-]?\s*{_IDENT}[^%\n]{{0,60}}%> | [$\#]\{{\s*{_IDENT}\s*\}}
    | (?<!\w)%[A-Z][A-Z0-9_]{{2,40}}%(?!\w) | (?<!\w)%\({_IDENT}\)[sd] | \[\[\s*{_IDENT}(?:[ _]{_IDENT})*\s*\]\] | (?<![\w$\#{{])\{{\s*{_IDENT}(?:[ ]{_IDENT})?\s*\}}(?!\}})
    | (?<![\w\]!])\[(?=[^\]]{{0,42}}[A-ZÄÖÜÀ-Þ]{{3}})[A-ZÄÖÜÀ-Þ][A-ZÄÖÜÀ-Þ0-9 _/'’-]{{2,40}}\](?![(\w\[]) | <<\s*{_IDENT}(?:[ _]{_IDENT})*\s*>> | «\s*[a-zA-Z]+_[\w]+\s*» | (?<!\w)__[A-Z][A-Z0-9_]*[A-Z0-9]__(?!\w)
    | (?<![\w<])<(?=[A-ZÄÖÜ])[A-ZÄÖÜ][A-ZÄÖÜ0-9]*[ _][A-ZÄÖÜ0-9 _]{{2,40}}> | (?<!\w)@@\w+@@ | (?<![\w$])\$[A-Z][A-Z_]{{3,30}}\$(?!\w) | \#\#[A-Z_]{{3,30}}\#\# | (?<!\w)(?:\*\|[A-Z_:]+\|\*)""",
    re.X,
)
#: What fields of letters and forms are named after, and how instructions to fill them begin or end.
_NOUN = """name|first\\s?name|last\\s?name|surname|full\\sname|customer(?:\\sname)?|client(?:\\sname)?|company(?:\\sname)?|firm|department|branch|service|date|due\\sdate|deadline|time|amount|sum|price|total|city|town|street|address|zip|country|reference(?:\\snumber)?|number|order(?:\\snumber)?|invoice(?:\\snumber)?|project(?:\\stitle)?|title|subject|topic|phone|e-?mail|contact(?:\\sperson)?|recipient|sender|signature|position|product|text
|vorname|nachname|kunde|kundenname|firma|abteilung|datum|frist|betrag|summe|ort|stadt|straße|adresse|anschrift|aktenzeichen|referenz|projekt|projekttitel|titel|betreff|ansprechpartner|unterschrift|telefon
|nom|prénom|client|société|entreprise|département|service|échéance|montant|ville|rue|adresse|référence|numéro|projet|titre|objet|téléphone
|nombre|apellidos?|cliente|empresa|departamento|fecha|plazo|importe|ciudad|calle|dirección|referencia|número|proyecto|título|asunto|teléfono
|nome|cognome|azienda|reparto|data|scadenza|importo|città|via|indirizzo|riferimento|progetto|titolo|sobrenome|prazo|valor|cidade|rua|endereço|referência|projeto|assunto
|naam|voornaam|achternaam|klant|bedrijf|afdeling|bedrag|plaats|straat|adres|kenmerk|onderwerp|imię|nazwisko|firma|dział|kwota|miasto|ulica|termin|numer|temat|имя|фамилия|дата|сумма|город|улица|адрес|компания|отдел|номер|тема|氏名|名前|会社名|部署|日付|金額|住所|件名|番号|電話番号""".replace("\n", "")
_DO = """please\\s(?:insert|enter|add|fill)|insert|enter|add|fill\\sin|your|choose|select|type|write|escriba|inserta?r?e?|introduzca|introducir|indique|indicar|su|rellen[ae]r?|añad[ae]|saisir|saisissez|ins[ée]re[rz]|indiquer|indiquez|compl[ée]te[rz]|votre|bitte|ihren?|ihre|hier|inserire|inserisci|indicare|il\\stuo|inserir|insira|preencher|seu|sua|invoegen|vul|uw|wpisz|wstaw|podaj|введите|вставьте|укажите|ваш[ае]?"""
_END = """here|goes\\shere|einfügen|eintragen|einsetzen|ergänzen|eingeben|hier|ici|aquí|aqui|qui|invoegen|invullen|tutaj|здесь|を入力|を記入"""
_ASKED = rf"(?:(?:{_DO})\s[^\[\](){{}}<>«»\n&]{{1,40}}|[^\[\](){{}}<>«»\n&.]{{1,40}}?\s?(?:{_END}))"
_NAMED = rf"(?:(?:{_DO})\s)?(?:(?:{_NOUN})(?:[ _](?:{_NOUN}))?)(?:\s(?:{_END}))?"
_ASK = re.compile(
    rf"""\[\s*(?:{_ASKED}|{_NAMED})\s*\](?![(\w]) | (?<!\w)\(\s*(?:(?:{_DO})\s(?:\w+\s)?(?:{_NOUN})(?:\s\w+)?(?:\s(?:{_END}))?|(?:{_NOUN})\s(?:{_END}))\s*\) | (?:<|&lt;)\s*(?:{_ASKED}|{_NAMED})\s*(?:>|&gt;)
    | «\s?(?:{_NAMED}|(?:{_DO})\s(?:{_NOUN}))\s?» | ‹\s?{_NAMED}\s?› | (?<!\w)\$[A-Z][A-Za-z]+(?:_\w+)*\$(?!\w) | (?<![\w~])~[A-Za-z]\w{{1,30}}~(?![\w~]) | (?<![\w{{$%\\])\{{\d{{1,2}}\}}(?!\w)
    | (?<!\w)(?:XX|xx|TT|DD|JJ|MM|dd|__)[./-](?:XX|xx|MM|mm|__)[./-](?:20)?(?:XX(?:XX)?|xx(?:xx)?|JJJJ|YYYY|AAAA|__|yyyy)(?!\w) | (?<!\w)X{{4,}}(?!\w) | (?<![_\w])_{{4,}}(?![_\w])""",
    re.I | re.X,
)
#: Words of a sentence that writes about fields.
_TOLD = re.compile(r"\b(?:fields?|placeholders?|templates?|variables?|syntax|markup|merge|markers?|manual (?:shows|says)|felder?|feldern|platzhalter|vorlagen?|serienbrief|champs?|modèles?|balises?|campos?|plantillas?|marcador(?:es)?|segnaposto|modello|modelos?|velden|veld|sjabloon|pola|pole|szablon\w*|поля|поле|шаблон\w*)\b|テンプレート|プレースホルダ", re.I)
_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_INLINE = re.compile(r"`[^`\n]{1,200}`|<(?:code|pre)\b[^>]*>.*?</(?:code|pre)>", re.S | re.I)
_QUOTED = re.compile(r"[\"“”'‘’«»„]$")
_CODE_LINE = re.compile(r"^(?: {4,}|\t)\S|[;{]\s*$|^\s*(?:def|class|import|from|return|for|if|while|export|echo|var|let|const|function|public|private|print|SELECT|INSERT)\b.*[(){};=]|^\s*[\"']?[\w.-]+[\"']?\s*[:=]\s*[\"'{\[].*[\"'}\]],?\s*$|^\s*(?:\$|>>>|#!)\s*\S")


def without_code(text: str) -> str:
    """The text with code blocks and inline code blanked out."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "`" in text or "<code" in text or "<pre" in text:
        text = _INLINE.sub(" ", text)
    return text


def template_fields(text: str, alternatives: list[re.Pattern] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, text without code) of each unfilled field in running text."""
    plain, out, last = without_code(text), [], -1
    for m in sorted((m for p in ([_FIELD, _ASK] if alternatives is None else alternatives) for m in p.finditer(plain)), key=lambda m: (m.start(), -m.end())):
        if m.start() < last:
            continue  # within a field that counts already
        a = plain.rfind("\n", 0, m.start()) + 1
        b = plain.find("\n", m.end())
        line = plain[a : b if b >= 0 else len(plain)]
        if _CODE_LINE.search(line):
            continue
        rest = line.replace(m.group(), " ")
        if m.group()[0] in "_Xx" and sum(map(str.isalpha, rest)) < 6:
            continue  # a rule across the page
        begin = max(a, max(plain.rfind(x, a, m.start()) for x in (". ", "! ", "? ", "; ")))
        if _TOLD.search(plain, begin, m.start()):
            continue
        letters = sum(c.isalpha() or c == " " for c in rest)
        if len(rest) > 20 and letters < 0.55 * len(rest):
            continue  # not running text: symbols, data, coded
        if _QUOTED.search(plain[max(0, m.start() - 1) : m.start()]) and plain[m.end() : m.end() + 1] in "\"”’'»“":
            continue  # a field that is spoken of
        out.append((m.start(), m.end(), plain))
        last = m.end()
    return out


# ---------------------------------------------------------------- passages

#: Words of the usual pseudo-Latin filler.
LOREM = set(
    """lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi
    aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit
    anim id est laborum vitae turpis massa felis porta ornare risus lectus mauris vestibulum viverra pellentesque tincidunt egestas praesent faucibus sagittis""".split()
)

_SCRIPT = re.compile(
    r"""java\s?script|no\s?script|scripting|\bJS\b|\b(?:scripts?|skripte?n?|skryptów|skrypty|скрипт\w*|スクリプト|guiones|script\sattivi)\b|browser\s(?:could\snot|cannot|can't)\srun|run\sour\scode|checking\syour\sbrowser""",
    re.I | re.X,
)
_SCRIPT_ASK = re.compile(
    r"""enabl|activ|aktiv|necesit|precisa|potrzeb|нужен|нужн|nodig|habilit|abilit|attiv|włącz|включ|отключ|ative\b|schakel|turn\son|switch\son|allow|requir|need|nécessit|benötig|erforder|exig|richied|wymaga|vereist|werkt\sniet|zonder|ohne|sans|senza|sin\b|sem\b|bez|без|disabled|désactiv|deaktiv|desactiv|disattiv|desativ|uitgeschakeld|wyłączon|blocked|bloqu|blockier|bloccat|zablokow|geblokkeerd|заблокир|noscript|could\snot\srun|cannot|führt|funktioniert|有効|無効|必要|checking\syour\sbrowser|not\sload|no\sadmite|not\ssupport|unterstützt\skein|ne\sprend|non\ssupport|não\ssuport|niet\sondersteun|nie\sobsługuj|не\sподдержив|properly\swithout|work\sproperly""",
    re.I | re.X,
)
#: A sentence that tells of an error or of filler is none.
_TELLS = re.compile(r"\b(?:told|said|wrote|explained|answered with|filled the|so that the|because the|was a full disk|erzählte|berichtete|a expliqué|explicó|ha spiegato)\b", re.I)
#: Running prose about scripts isn't a notice.
_ABOUT = re.compile(r"needs no javascript|block scripts see|without any|as a plain image|\b(?:he|she|they|we) (?:wrote|explained|described)\b", re.I)

_ERROR = re.compile(
    r"""^\W*(?:(?:http\s)?(?:error|fehler|erreur|errore|erro|fout|błąd|ошибка|エラー|código|code)\W{0,3}\s?\d{2,4}\b|[45][0-9][0-9]\W{0,3}\s?(?:not\sfound|bad\s|forbidden|internal|service|gateway|seite|page|página|pagina|error|unavailable|too\smany|unauthorized|access|request|страница|strona|ページ|erreur|fehler|errore|niet|nie\s|non\s|no\s)|error\scode\b)
    |(?:page|seite|página|pagina|strona|страниц\w|ページ|url|site|resource|file|document)\b.{0,40}(?:not\sfound|could\snot\sbe\sfound|nicht\sgefunden|introuvable|n'existe\splus|no\s(?:encontrad|existe|disponible)|ya\sno\sexiste|não\s(?:encontrad|existe)|non\s(?:trovat|esiste|disponibile)|niet\s(?:gevonden|beschikbaar|bestaat)|bestaat\sniet|nie\s(?:została\s)?znalezion|nie\sistnieje|не\s(?:найден|существует)|見つかりません|moved\sor\sdeleted|verschoben\soder\sgelöscht|can't\sbe\sreached|cannot\sbe\sreached|no\slonger\s(?:exists|available)|existiert\snicht|verplaatst|usunięt|удален|eliminad|removid|supprim|rimoss)
    |(?:access|zugriff|accès|acceso|accesso|acesso|toegang|dostęp|доступ)\b.{0,20}(?:denied|verweigert|refusé|denegado|negato|negado|geweigerd|zabroniony|запрещ\w+|forbidden)|アクセス.{0,8}拒否
    |don't\shave\spermission|do\snot\shave\spermission|authorization\srequired|not\sauthori[sz]ed\sto\s(?:view|access)|odmowa\sdostępu|keine\sberechtigung|session\s(?:has\s)?(?:expired|timed\sout)|login\shas\stimed\sout|sitzung\s(?:ist\s)?abgelaufen|session\sa?\s?expir|sesión\s(?:ha\s)?(?:expirado|caducado)|request\stimed\sout|timed?\sout,?\splease|gateway\stime-?out|server\s?fehler|serverfout|erreur\sinterne|error\sinterno|errore\sinterno|erro\sinterno|wewnętrzny\sbłąd|внутренняя\sошибка|server\serror|内部エラー|too\smany\srequests|service\sunavailable|servizio\snon\sdisponibile|servicio\sno\sdisponible|serviço\sindisponível|service\sindisponible|dienst\s(?:nicht\sverfügbar|niet\sbeschikbaar)|bad\sgateway|internal\sserver\serror
    |server\s(?:took\stoo\slong|returned\san\sinvalid|is\s(?:down|overloaded|unavailable)|antwortet\snicht|error)|upstream\s(?:server|timeout)|could\snot\sconnect\sto|unable\sto\sconnect|verbindung.{0,20}fehlgeschlagen|connection\s(?:refused|reset|timed)
    |\b(?:error|fehler|erreur|errore|erro|fout|błąd|ошибка)\s[45][0-9][0-9]\b|failed\sto\sopen\s(?:stream|file)|cannot\smodify\sheader|\.php\son\sline|undefined\s(?:variable|index|offset|method|function)|call\sto\sundefined|(?:parse|syntax)\serror,?\sunexpected|sqlstate\[|ora-[0-9]{5}|you\shave\san\serror\sin\syour\ssql
    |fatal\serror|uncaught\sexception|traceback\s\(most\srecent|stack\strace|nullpointerexception|\b\w+(?:\.\w+)+exception\b|^\s*at\s[\w.$<>]+\([\w.]+:\d+\)|segmentation\sfault|errno\s\d|exception\sin\s\S+\son\sline
    |requested\surl|this\ssite\scan't|nothing\sto\ssee|we\sare\sworking\son\sit\sand\swill|be\sback\sshortly|under\smaintenance|wartungsarbeiten|down\sfor\smaintenance|(?:can't|cannot|could\snot)\sfind\sthat|en\smaintenance|en\smantenimiento|in\smanutenzione|em\smanutenção|in\sonderhoud|технические\sработы
    |(?:please\s)?try\sagain\s(?:later|in)|später\s(?:erneut|noch\seinmal|wieder)|réessayer\splus\stard|inténtelo\sde\snuevo|riprov\w+\spiù\stardi|tente\s(?:novamente|mais\starde)|probeer\shet\s(?:later|opnieuw)|spróbuj\s(?:ponownie|później)|попробуйте\sпозже|повторите\sпопытку|後でもう一度
    |quote\srequest\sid|request\s?id\W|^\W*(?:vorgangsnummer|référence|referencia|referência|riferimento|referentie|código|codice|numer|reference|kenmerk|incident|zgłoszenie|номер|код|コード|参照)\W{0,3}\s?(?:id\s)?\d{5,}\W*$|^\W*ray\s(?:id\W*)?[0-9a-f]{6,}|<error>.*</error>|<code>\w+</code>|\"(?:status|error)\"\s?:\s?(?:[45]\d\d|\"\w)|"path"\s?:|go\sback\sto\sthe\shome\s?page|something\swent\swrong|^\W*oops\b|an\serror\s(?:has\s)?occur""",
    re.I | re.X | re.S,
)

_FILLER = re.compile(
    r"""lorem\sipsum|blindtext|platzhalter|beispieltext|mustertext|fülltext|text\sfolgt|hier\ssteht\sspäter|hier\sentsteht|hier\skommt|titel\sdurch\sklicken|durch\sklicken\shinzufügen
    |placeholder|dummy\s(?:text|paragraph)|sample\stext|filler\stext|text\sto\sfollow|(?:your|insert)\s(?:text|content|body\scopy|title|copy)\b|insert\sbody|add\s(?:your|a)\s(?:text|title|subtitle)|write\sa\sshort\sintroduction|replace\sthis\s(?:paragraph|text)|click\sto\s(?:add|edit)|type\s(?:your|something)\s?(?:text|here)?\shere|^\W*(?:todo|tbd|tbc|xxx)\b\W|to\sbe\sreplaced\slater|content\s(?:goes|comes)\shere|coming\ssoon
    |texte?\s(?:d'exemple|factice|à\svenir)|faux\stexte|paragraphe\sfactice|votre\s(?:texte|titre)\sici|cliquez\spour\s(?:ajouter|modifier)|insérez\s(?:votre|le)\stexte|remplacez\sce|texte\sde\sremplissage
    |texto\s(?:de\s(?:relleno|ejemplo|muestra|exemplo|preenchimento)|pendiente|provis)|párrafo\sde\sejemplo|aquí\sva\s(?:el|su)|haga\sclic\spara\s(?:agregar|añadir)|escriba\s(?:aquí|su)|su\stexto\saquí|sustituya\seste
    |testo\s(?:di\s(?:esempio|prova|riempimento)|segnaposto|provvisorio|in\sarrivo)|segnaposto|inserire?\s(?:qui|il)\s(?:il\s)?testo|fare\sclic\sper|fai\sclic\sper|clique\spara\s(?:adicionar|editar)|insira\s(?:o\s|seu\s)?texto|seu\stexto\saqui|parágrafo\sde\sexemplo
    |voorbeeldtekst|opvultekst|plaatshouder|tekst\svolgt|klik\som\s(?:een\s|tekst|titel)|uw\stekst\shier|hier\skomt\s|tekst\s(?:zastępczy|przykładowy|próbny)|przykładowy\s(?:tekst|akapit)|wstaw\stekst|kliknij,?\s(?:aby|żeby)\s|tutaj\s(?:będzie|wpisz)
    |текст[-\s](?:заполнитель|рыба)|пример\sтекста|здесь\s(?:будет|появится)|образец\sтекста|вставьте\sтекст|щ[её]лкните,?\sчтобы|ダミーテキスト|サンプルテキスト|ここに.{0,12}(?:入力|テキスト|文章)|仮の(?:文章|テキスト)|クリックして.{0,10}(?:追加|入力)""",
    re.I | re.X,
)
#: Page furniture, which counts for nothing on either side.
_FURNITURE = re.compile(
    r"""^\W*(?:home|start|menu|menü|reload|search|contact|loading|redirecting|nginx\S*|apache\S*|noscript|log\s?in|register|sign\sin|skip\sto|©|copyright|back\sto|return\sto\sthe|zurück|volver|retour|torna|voltar|terug|wróć|назад|ray|cookies?)\b.{0,60}$|^\W*(?:©|\d{1,4}|[A-Z]\w*(?:\s[A-Z&]\w*){0,3})\W*$|^[^\w]*$|^\W*home\s/[^.!?]{0,60}$""",
    re.I | re.X,
)
_FURNITURE_STRICT = re.compile(r"^\W*(?:©.*|\d{1,4}|[A-ZÀ-Þ][\w&]*(?:\s(?:[A-ZÀ-Þ&][\w&]*|GmbH|Ltd)){0,3})\W*$")
_SPLIT = re.compile(r"\s(?:(?<=[.!?…。]\s)\s*(?=\S)|[-–|·]\s(?=[A-ZÀ-ÞА-Я\d<{\"]))")

#: A sign of residue speaks for so many characters of its passage; a longer passage is judged by what its signs cover.
STRETCH = 300
#: Shortest word of the pseudo-Latin filler that gives it away; a filler passage has one of them.
TELLING = 5
_LETTERS = re.compile(r"[^\W\d_]+")
#: Longest series of words that filler repeats, and how often on end it does.
PERIOD, REPEATS = 4, 4
_WORDS = re.compile(r"\S+")


@cache
def rules() -> Rules:
    """All patterns behind one automaton of the literals that they need, so that a pattern runs where it can match."""
    patterns = {"error": _ERROR, "filler": _FILLER, "script": _SCRIPT, "field": _FIELD, "ask": _ASK}
    words = {w for w in LOREM if len(w) >= TELLING and w not in ("minim", "culpa", "massa", "porta")}
    return Rules({k: (p.pattern, p.flags & ~re.U) for k, p in patterns.items()}, {"lorem": words})


def passages(text: str) -> list[tuple[int, int]]:
    """Where sentences and lines begin and end, white space at their ends left out."""
    out, at = [], 0
    for line in text.split("\n"):
        out += _in_line(line, at)
        at += len(line) + 1
    return out


def _in_line(line: str, at: int) -> list[tuple[int, int]]:
    out, begin = [], 0
    for m in [*_SPLIT.finditer(line), None]:
        p = line[begin : m.start() if m else len(line)]
        if p and not p.isspace():
            a = at + begin + len(p) - len(p.lstrip())
            out.append((a, a + len(p.strip())))
        begin = m.end() if m else begin
    return out


def _places(plain: str, hits: list[tuple[int, tuple[int, ...]]] | None, signs: set[int]) -> dict[tuple[int, int], set[int]]:
    """The rules that may hold in each passage; without hits, all of `signs` in every passage."""
    if hits is None:
        return {p: signs for p in passages(plain)}
    out: dict[tuple[int, int], set[int]] = {}
    spans, begins, stop = [], [], -1
    for end, rs in hits:
        rs = signs.intersection(rs)
        if not rs:
            continue
        if end > stop:  # the next line that has a literal
            start = plain.rfind("\n", 0, end + 1) + 1
            stop = plain.find("\n", end)
            stop = len(plain) if stop < 0 else stop
            spans = _in_line(plain[start:stop], start)
            begins = [a for a, _ in spans]
        k = bisect.bisect_right(begins, end) - 1
        if k >= 0:
            out.setdefault(spans[k], set()).update(rs)
    return out


def _covered(p: str, places: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """Characters of a passage within the stretches around some places, and those stretches."""
    if len(p) <= STRETCH:
        return (len(p) if places else 0), [(0, len(p))] if places else []
    spans: list[tuple[int, int]] = []
    for a, b in sorted(places):
        lo = max(0, min((a + b - STRETCH) // 2, a, len(p) - STRETCH))
        hi = max(b, lo + STRETCH)
        if spans and lo <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
        else:
            spans.append((lo, hi))
    return sum(b - a for a, b in spans), spans


def _lorem(p: str) -> int:
    """Characters of a passage in pseudo-Latin, judged by blocks of up to STRETCH characters."""
    n, block = 0, []
    for m in [*_LETTERS.finditer(p), None]:
        if block and (m is None or m.end() - block[0].start() > STRETCH and len(p) > STRETCH):
            known = sum(x.group().lower() in LOREM for x in block)
            if known > 0.7 * len(block) and (len(block) >= 4 or any(x.group().lower() == "lorem" for x in block)):
                n += len(p) if len(p) <= STRETCH else (m.start() if m else len(p)) - block[0].start()
            block = []
        if m is not None:
            block.append(m)
    return n


def repeated(text: str) -> list[tuple[int, int]]:
    """Stretches in which up to PERIOD words with letters come REPEATS times or more on end, as in "asdf asdf asdf asdf"."""
    words = text.split()
    if len(words) < REPEATS or 2 * len(set(words)) > len(words):
        return []
    found = list(_WORDS.finditer(text))
    out: list[tuple[int, int]] = []
    for period in range(1, PERIOD + 1):
        begin = 0
        for i in range(period, len(words) + 1):
            if i < len(words) and words[i] == words[i - period]:
                continue
            if i - begin >= REPEATS * period and all(any(map(str.isalpha, w)) for w in words[begin : begin + period]):
                out.append((found[begin].start(), found[i - 1].end()))
            begin = i - period + 1
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def judge(p: str, which: dict[str, list[re.Pattern | None]]) -> tuple[str, int]:
    """The kind of a passage (script, filler, error or other), and its characters of that kind."""
    best = ("other", 0)
    if "script" in which:
        at = [m.span() for r in which["script"] for m in r.finditer(p)]
        at = [s for s in at for _, w in [_covered(p, [s])] if _SCRIPT_ASK.search(p, *w[0]) and not _ABOUT.search(p, *w[0])]
        best = ("script", _covered(p, at)[0])
    if not best[1] and "lorem" in which:
        best = ("filler", _lorem(p))
    for kind in ("filler", "error"):
        if not best[1] and kind in which:
            at = [m.span() for r in which[kind] for m in r.finditer(p)]
            at = [s for s in at for _, w in [_covered(p, [s])] if not _TELLS.search(p, *w[0])]
            best = (kind, _covered(p, at)[0])
    return best if best[1] else ("other", 0)


def furniture(p: str) -> bool:
    return len(p) < 80 and bool(_FURNITURE_STRICT.match(p) or _FURNITURE.match(p))


def examine(text: str) -> tuple[list[tuple[int, int, str]], dict[str, int], list[str]]:
    """The unfilled fields of a text, its characters by kind (filler, error, script, other), and its residue passages.

    Every passage counts, whatever its length; a pattern is run on the passages that have a literal it needs.
    """
    own, folded = rules(), fold(text)
    hits = own.hits(folded)
    present = {r for _, rs in hits for r in rs}
    fields = template_fields(text, [own.rules[r][1] for r in sorted(present) if own.rules[r][0] in ("field", "ask")]) if any(own.rules[r][0] in ("field", "ask") for r in present) else []
    n = {"filler": 0, "error": 0, "script": 0, "other": 0}
    signs = {r for r in present if own.rules[r][0] in ("error", "filler", "script", "lorem")}
    again = repeated(text)
    if not signs and not again:
        return fields, n, []
    plain = without_code(text)
    if plain is not text:
        again = repeated(plain)
        folded = fold(plain)
        hits = own.hits(folded)
    found: dict[tuple[int, int], tuple[str, int]] = {}
    for (a, b), rs in _places(plain, hits if len(folded) == len(plain) else None, signs).items():
        which: dict[str, list] = {}
        for r in sorted(rs):
            which.setdefault(own.rules[r][0], []).append(own.rules[r][1])
        kind, chars = judge(plain[a:b], which)
        if chars:
            found[a, b] = (kind, chars)
    if not found and not again:
        return fields, n, []
    for a, b in passages(plain):
        kind, chars = found.get((a, b), ("other", 0))
        if again and not chars and (chars := sum(max(0, min(b, y) - max(a, x)) for x, y in again)):
            kind = "filler"
            found[a, b] = (kind, chars)
        n[kind] += chars
        if chars or not furniture(plain[a:b]):
            n["other"] += b - a - chars
    return fields, n, [plain[a:b] for a, b in sorted(found)]


def residue_share(n: dict[str, int]) -> float:
    """Share of filler, errors and notices in the characters outside of page furniture."""
    total = sum(n.values())
    return (total - n["other"]) / total if total else 0.0
