"""Template residue, filler, error pages and script notices in place of content.

Whole sentences of known pages would find only those pages. So one multi-pattern
automaton holds short phrases and stems of words in ten languages, each with the
classes it stands for (a page or server; a failure; a switch to turn on; a script;
wording about the parts of a commit; unset values; filler ...). It runs over the
folded words of a text once. What is said then follows from classes that occur
together: a *subject* with a *failure* in one part, a *script* or *cookie* with a
*switch*, slots of templates beside words of a frame. A part is residue if such a
sign is there and nearly all of its content words belong to the same field; a text
that mentions, quotes or edits such wording holds other content words besides.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from http import HTTPStatus
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least share of a message's content words that belong to the field of its sign; of what stands where a diff should be.
COVERAGE = 0.8
COVERAGE_INSTEAD = 0.6

# Classes of words; PAGE marks what belongs to the field of error pages and notices.
PAGE, SUBJECT, FAIL, SCRIPT, COOKIE, SWITCH, ACT, NOT, TELL, GLUE, SLOT, WEAK, FRAME, PART, TEMPLATE, UNSET, FILLER, VERB, STATUS, ERROR, MAINT, READER = (1 << k for k in range(22))

# Wording, by class. A star ends a stem; phrases are matched as folded words, without accents.

#: What an error page is about.
SUBJECTS = """
page* | site | website* | web site | server* | service* | connection* | host | address | session* | resource* | link | url | request* | access* | network | proxy | gateway | back end | backend | upstream | route | path | portal
view | viewer | account | login | application | app | content* | system | repository | repositories | repo | diff* | patch* | change* | revision* | project* | tree | browser* | ip | client | database | document* | origin | domain | endpoint
seite | dienst* | verbindung* | zugriff* | zugang* | sitzung* | adresse* | anfrage* | anforderung* | ressource* | inhalt* | netzwerk* | anderung* | anwendung* | angeforderte*
serveur* | connexion* | acces | requete* | contenu* | modification* | demande* | lien | navigateur* | reseau
pagina* | servidor* | servicio* | conexion* | acceso* | sesion* | direccion* | recurso* | solicitud* | peticion* | contenido* | cambio* | navegador* | enlace* | sitio
servico* | conexao | ligacao | acesso* | sessao | endereco* | pedido* | conteudo* | alteracao* | solicitacao*
servizio* | connessione* | accesso* | sessione* | indirizzo* | risorsa* | richiesta* | contenuto* | modifica | collegamento* | sito
toegang* | verbinding* | sessie* | verzoek* | strona | strony | serwer* | usluga | polaczeni* | dostep* | sesja | zadani* | страниц* | сервер* | сервис* | соединени* | доступ* | сесси* | запрос* | ресурс* | адрес*
"""
#: What went wrong with it.
FAILURES = """
not found | unavailable | unreachable | offline | crashed | reset | refused | blocked | banned | denied | forbidden | expired | ended | closed | moved | deleted | removed | broken | dead | timed out | time out | timeout | invalid | failed | failure* | down
wrong | exceeded | unauthorized | unauthorised | overloaded | busy | missing | lost | interrupted | aborted | terminated | suspended | restricted | unsupported | not available | not responding | no longer | not here | any more | anymore | gone | no answer | no response | no route | does not exist | rejected | malformed | too many | too long | too large | too big | unexpected* | limited
nicht gefunden | nicht erreichbar | nicht verfugbar | unerreichbar | verweigert | gesperrt | abgelaufen | unterbrochen | fehlgeschlagen | ungultig* | gestort | uberlastet | beendet | verschoben | geloscht | untersagt | existiert nicht
introuvable* | indisponible* | refuse | refusee | interdit* | expire | expiree | bloque | bloquee | perdue | echoue | injoignable | surcharge | terminee | deplacee | supprimee | inaccessible | n existe | non trouvee | non autorise
no disponible | denegad* | prohibid* | caducad* | expirad* | bloquead* | perdid* | fallo | fallid* | inaccesible | sobrecargad* | no existe | eliminad* | movid* | no encontrad* | no se encontro | no se ha encontrado
indisponivel | indisponiveis | negad* | proibid* | expirou | falhou | inacessivel | removid* | excluid* | nao existe | nao encontrad* | nao foi encontrad*
non trovat* | non disponibil* | negat* | vietat* | scadut* | bloccat* | fallit* | irraggiungibil* | spostat* | rimoss* | non esiste
niet gevonden | niet beschikbaar | geweigerd | verlopen | mislukt | nie znaleziono | nie zostala znaleziona | niedostepn* | zabroniony | wygasl* | не найден* | недоступ* | запрещ* | истек* | не отвечает | прервано
"""
#: What could not be done.
ACTS = """
load* | found | find | finding | display* | open* | reach* | process* | show* | render* | complete* | respond* | reply | replied | answer* | connect* | fetch* | retrieve* | serve* | handle | read* | view | shown | loaded | matches | match
laden | geladen | anzeigen | angezeigt | offnen | geoffnet | gefunden | erreicht | verarbeitet | beantwortet | charger | chargee | afficher | affichee | ouvrir | trouver | trouvee | traiter | traitee
cargar* | cargad* | mostrar* | abrir* | encontrar | encontrad* | procesar* | procesad* | carregar* | carregad* | exibir* | encontrado | processar* | caricare | caricat* | mostrare | aprire | trovare | trovat*
"""
NEGATIONS = """
cannot | can t | can not | couldn t | could not | unable | failed to | failed | didn t | did not | doesn t | does not | is not | isn t | was not | wasn t | won t | will not | trouble | lack* | nicht | kein* | konnte | impossible | pas | ne | ni | no se pudo | no pudo | no | nao | non | impossibile | niet | nie | не
"""
SCRIPTS = """
javascript | java script | ecmascript | js | scripts | scripting | script execution | client side scripts | client side scripting | skripte | скрипт* | скрипты
"""
COOKIES = "cookie* | куки"
#: Wording that turns to the reader.
READERS = "you | your | please | kindly | oops | sorry | whoops | hmm | apolog* | bitte | sie | ihr | ihre | ihrem | ihren | vous | votre | veuillez | desole* | su | usted | por favor | seu | sua | voce | lo sentimos | desculpe | spiacent* | tuo | uw | alstublieft | prosimy | пожалуйста | ваш* | вы | 请 | ください"
#: To turn on, to need, to be off.
SWITCHES = """
enable* | activate* | turn on | turn it on | turned on | turned off | switch on | switch it on | switched on | switched off | allow* | unblock* | permit* | accept* | require* | need* | disable* | deactivate* | inactive | off | consent* | support* | must be | depend* | without | with scripts
aktivier* | deaktivier* | einschalten | schalten | eingeschaltet | ausgeschaltet | erlaube* | zulassen | benotig* | erforderlich | braucht | akzeptier*
activez | activer | active | activado | desactive* | besoin | necessite* | requis | requiert | autoris* | accepte* | desactivad* | habilit* | necesit* | requier* | acept* | permit*
ative | ativar | ativado | desativad* | precis* | requer | aceit* | attiv* | abilit* | disattivat* | richied* | necessari* | accett* | schakel | inschakelen | vereist | wlacz* | wymaga* | включи* | отключ* | требу* | разреши* | 启用 | 啟用 | 有効
"""
#: Wording that tells a page or notice by itself, besides the reason phrases of HTTP.
TELLS = """
access denied | access forbidden | permission denied | page not found | went wrong | error occurred | error has occurred | unexpected error | we are sorry | traceback | upstream connect error | stack trace | fatal error | under maintenance | down for maintenance | scheduled maintenance | be back soon | be back shortly | temporarily unavailable | temporarily offline | core dumped | out of service
do not have permission | don t have permission | not authorized | not authorised | lack the permission | lack permission* | insufficient permission* | insufficient privilege* | session has | session expired | sign in again | signed in | logged in | please sign in | please log in | sign in to | log in to | login required | authentication required | sign in | rate limit | rate limited | slow down | unusual traffic | quota exceeded | your address | your ip | have access | unusual activity | suspicious activity
checking your browser | verify you are | verifying you are | are you a robot | are human | security check | stand by | ddos protection | attention required | ray id | captcha | cloudflare | too many requests | rate limit exceeded | could not be displayed | cannot be displayed | could not be shown
zugriff verweigert | kein zugriff | nicht angemeldet | bitte melden | melden sie sich | anmeldung erforderlich | zu viele anfragen | fehler aufgetreten | wartungsarbeiten | keine berechtigung | einen moment | browser wird | seite nicht gefunden
acces refuse | acces interdit | connectez vous | veuillez vous connecter | trop de requetes | erreur est survenue | erreur s est produite | en maintenance | en cours de maintenance | page introuvable | page non trouvee | vous connecter | autorisation requise
acceso denegado | inicie sesion | demasiadas solicitudes | demasiadas peticiones | producido un error | ocurrido un error | en mantenimiento | no tiene permiso | acesso negado | faca login | muitas solicitacoes | muitos pedidos | ocorreu um erro | em manutencao | inicie a sessao | nao tem permissao | pagina no encontrada | pagina nao encontrada
accesso negato | accedi per | troppe richieste | verificato un errore | in manutenzione | non hai i permessi | pagina non trovata | pagina niet gevonden | toegang geweigerd | te veel verzoeken | fout opgetreden | in onderhoud | dostep zabroniony | wystapil blad | przerwa techniczna | доступ запрещен | произошла ошибка | слишком много запросов | войдите | технические работы
页面不存在 | 页面未找到 | 找不到页面 | 访问被拒绝 | 服务不可用 | 请求过多 | 请登录 | 维护中 | ページが見つかりません | アクセスが拒否されました | メンテナンス中 | エラーが発生しました | ログインしてください
"""
ERRORS = "error* | fault | fehler* | erreur* | errore* | erro | erros | fout | blad | ошибка | 错误 | エラー | http | status | code"
#: Upkeep of a site.
UPKEEP = "maintenance | wartung | wartungsarbeiten | mantenimiento | manutencao | manutenzione | onderhoud | konserwacja | обслуживание | upgrade | upgrading"
#: Other words of such pages; they tell nothing.
PAGE_WORDS = """
sorry | oops | whoops | hmm | uh oh | having | trouble | unusual | apolog* | inconvenience | please | kindly | problem* | issue* | internal | bad | remote | side | peer | team | told | notified | informed | engineer* | report* | reference | incident | id | ray | attempt* | code | log | contact* | admin* | administrator* | webmaster | support | help | quote | quoting | moment* | minute* | second* | hour* | few | while | shortly | soon | later | again | once more | once | try | retry | retrying | reload* | refresh* | wait* | back | return* | home | homepage | start | go on | go back | going on | continue* | proceed* | patience | thank* | thanks
check* | verify* | human | robot* | bot | security | secure | protection | traffic | many | limit* | rate | quota | user* | visitor* | password | permission* | privilege* | authoriz* | authoris* | authentica* | log in | logged | login | sign in | signed | sign | settings | setting | preferences | mode | best experience | experience | empty | blank | nothing | drawn | draw | works | work | only | reading | see | shown | look* | looking | follow* | requested | requires | asked | tried | trying | given | gave | took | time | mistake* | typo* | spelling | hosting | hosted | this | used | use | uses | using | properly | correctly | temporar* | momentar* | currently | moved | available | exist* | required | invalid | stays | render* | execution | ended | be | close | tab | cache | clear | image* | file* | code view | history | commit | source* | data | nginx | apache | httpd | varnish | haproxy | envoy | iis | cdn | noscript | enabled | enable | reader | feature* | function* | visit* | headers | header | before | connect* | cluster | edge | region | web | firewall | vpn | abuse | automated | activity | suspicious | detected | number | it
bitte | spater | erneut | versuchen | versuchs | derzeit | moment | momentan | wenden | administrator | kontakt* | melden | neu laden | zuruck | startseite | minuten | sekunden | sehen | anzuzeigen | einstellungen | browser | aufgetreten | leider | entschuldig* | vorubergehend | gibt | wurde | vielen | dank | geduld | ihre | ihrem | ihr
veuillez | reessayez | reessayer | plus tard | tard | momentanement | actuellement | instant* | minutes | secondes | afficher | voir | retour | accueil | contactez | administrateur | parametres | desole* | merci | patienter | rechargez | votre | quelques | interne
intentelo | intentarlo | intente | intentar | vuelva | inesperad* | inattes* | inattendu* | inesperad* | unerwartet* | busca | procura | cercata | recherchee | mas tarde | tarde | momento | minutos | segundos | nuevo | ver | volver | inicio | contacte | administrador | configuracion | lo sentimos | gracias | favor | recargue | actualmente | pueda | pudo | su | interno | temporalmente
tente | novamente | de novo | mais tarde | dentro | voltar | pagina inicial | contato | contacte | configuracoes | desculpe | obrigad* | recarregue | atualmente | seu | sua | moment* | foi possivel
riprova | riprovare | piu tardi | tardi | ricarica | torna | attualmente | minuti | secondi | vedere | visualizzare | spiacent* | grazie | probeer | opnieuw | later | sprobuj | ponownie | pozniej | повторите | попытку | попробуйте | позже | пожалуйста | обновите | извините | 请稍后再试 | 稍后 | しばらく
"""
#: Words of titles and labels that templates have around their slots.
FRAMES = """
release* | backport* | bump* | set | update* | change* | changed | add | added | fix* | feat | feature | remove* | rename* | merge* | revert* | perf | docs | doc | test* | tests | chore | refactor* | build | ci | style | move* | replace* | use | support | implement* | cleanup | improve* | introduce | upgrade* | sync* | port
first | second | third | fourth | last | next | another | further | longer | short | long | optional | brief | branch | old | new | file* | version* | reason | refs | ref | risk | impact | contact | reviewed | reviewer* | tested | signed off | closes | resolves | see also | see | part | related | ticket* | issue* | task | owner | author | date | scope | type | component | module | area | purpose | rollback | notes | details | team | requested | request | needed | number | line* | characters | signs | max | name | value | id | key | link | url | bug | story | project | co authored
betreff | grund | anderung* | titel | beschreibung | zusammenfassung | raison | titre | objet | motivo | titulo | asunto | descripcion | assunto | descricao | resumo | oggetto | titolo | descrizione
"""
#: The parts of a commit's message, as a template speaks of them.
PARTS = """
title | subject | summary | description | body | headline | paragraph* | heading | footer | trailer | message | commit message | commit title | text | placeholder | sentence* | overview | motivation | context | titel | beschreibung | zusammenfassung | absatz | betreff | titre | sujet | resume | paragraphe | titulo | asunto | resumen | descripcion | parrafo | assunto | resumo | descricao | paragrafo | titolo | oggetto | riassunto | descrizione
"""
#: Requests to fill something in.
PROMPTS = """
goes here | go here | text here | title here | message here | name here | summary here | description here | here | to be filled in | to be filled | fill in | fill this | filled in | fill out | to be done | to be determined | to be written | to be completed | tbd | tba | todo | fixme | replace this | replace with | replace me | change me | changeme | your title | your commit | your text | your message | your name | your change* | insert | enter a | enter the | enter your | describe | describe your | describe what | explain what | explain why | write a | write your | write the | provide a | add a description | optional | placeholder text | dummy text | sample text | example text | delete this | remove this | what does this | what was changed | why is | why was | why this | is this change | what changed | longer text | short summary | lines starting with
beispieltext | blindtext | platzhalter | hier steht | hier einfugen | bitte ausfullen | bitte beschreiben | a remplir | a completer | votre texte | inserer | decrivez | texto de ejemplo | su texto | inserte | describa | por completar | seu texto | insira | descreva | a preencher | testo di esempio | inserire | descrivere | da completare | vul in | uzupelnij | заполнить | 待填写 | ここに
"""
UNSETS = "none | null | undefined | nan | nil | undef | n a | object object | unset | void"
#: The usual Latin filler, and what hands type without thinking.
FILLERS = """
lorem | ipsum | dolor | sit | amet | consectetur | adipiscing | adipisicing | elit | sed | do | eiusmod | tempor | incididunt | ut | labore | et | dolore | magna | aliqua | enim | ad | minim | veniam | quis | nostrud | exercitation | ullamco | laboris | nisi | aliquip | ex | ea | commodo | consequat | duis | aute | irure | in | reprehenderit | voluptate | velit | esse | cillum | eu | fugiat | nulla | pariatur | excepteur | sint | occaecat | cupidatat | non | proident | sunt | culpa | qui | officia | deserunt | mollit | anim | id | est | laborum
blah | bla | asdf | asdfasdf | qwerty | qwertz | foo | bar | baz | qux | foobar | yada | abc | xyz | test
"""
#: Words without content of their own.
GLUES = """
a | an | the | this | that | these | those | it | its | is | are | was | were | be | been | being | has | have | had | do | does | did | will | would | can | could | should | must | may | might | to | of | in | on | at | by | for | from | with | as | and | or | but | if | so | than | then | there | here | you | your | we | our | us | i | me | my | they | their | them | he | she | who | which | what | when | where | why | how | not | no | any | some | all | more | most | very | just | too | also | out | up | into | over | s | t | d | m | ll | re | ve | o | c | l | n
der | die | das | den | dem | des | ein | eine | einen | einem | einer | ist | sind | wird | werden | wurde | hat | haben | sie | sich | es | er | ich | wir | uns | ihr | ihre | ihren | und | oder | aber | zu | zum | zur | im | am | an | auf | aus | bei | mit | nach | von | vor | um | fur | als | auch | nur | noch | dass | diese | dieser | dieses | diesen | nicht | ein
le | la | les | un | une | des | du | de | au | aux | et | ou | est | sont | a | ont | il | elle | vous | nous | ce | cet | cette | ces | que | qui | dans | sur | pour | par | avec | sans | en | y | ne | pas | plus | se | sa | son | ses | votre | vos | j | qu
voce | usted | muss | mussen | sein | kann | konnen | devez | doit | debe | deve | 的 | を | に | し | て | く | た | さ | い | の | は | か | て | す | ま | せ | ん | と | も | ら
el | los | las | una | unos | del | al | y | o | es | son | esta | este | estos | que | en | con | por | para | sin | se | su | sus | lo | le | ha | han | no | mas
o | os | as | um | uma | do | da | dos | das | no | na | nos | nas | ao | e | sao | esta | este | que | em | com | por | para | sem | se | seu | sua | foi | nao
il | lo | gli | i | un | una | uno | di | del | della | dei | delle | al | alla | da | dal | in | nel | nella | con | per | su | e | sono | si | che | non | questo | questa | het | de | een | van | te | met | voor | op | niet | is | deze | dit | w | z | i | na | do | nie | sie | jest | в | на | и | не | с | по | для | эта | это | или
"""
#: Verbs with which messages about a change begin.
VERBS = """
add | adds | added | fix | fixes | fixed | show | shows | handle | handles | retry | return | remove | removes | removed | rename | reject | rejects | move | drop | escape | stop | replace | render a | serve | improve | make | use | implement | introduce | catch | raise | test | document | refactor | update | updates | avoid | prevent | ignore | skip | treat | translate | reword | revert | merge | bump | clean | extract | split | simplify | validate | expose | restore | rework | tighten | align | inline | guard | pin | cache | deduplicate | reindent | speed | log | let | keep | hide | style | redirect | send | detect | link to | report a | mention | quote
behebe | erganze | entferne | fuge | verschiebe | vereinfache | prufe | zeige | andere | corrige | ajoute | retire | deplace | simplifie | verifie | anade | quita | mueve | simplifica | comprueba | muestra | adiciona | remova | verifica | aggiunge | rimuove | corregge
"""

#: Slots of templates by their delimiters. Each stops at the next delimiter of its kind, so that a long text is read once.
SLOTS = re.compile(
    r"\{\{\{?[^{}]*\}?\}\}|[$#@]\{[^{}]*\}|\$\([^()\n]*\)|<%[^%<]*%>|\{%[^%{}]*%\}|\[%[^%\[\]]*%\]|<\?[^?<>]*\?>|\[\[[^\[\]]+\]\]|\(\([^()]+\)\)|<<[^<>]+>>|«[^«»]+»|‹[^‹›]+›"
    r"|@@\w[\w. -]*@@|%%\w[\w. -]*%%|\$\$\w[\w. -]*\$\$|~~\w[\w. -]*~~|\|\|\w[\w. -]*\|\||(?<!\w)__[^\W_](?:[\w-]*?[^\W_])?__(?!\w)"
    r"|(?<![\w#])#[^\W\d][\w-]*#|(?<![\w%])%[^\W\d][\w-]*%|(?<![\w$])\$[^\W\d]\w*\$|(?<![\w@])@[^\W\d][\w-]*@(?!\w)|(?<![\w~])~[^\W\d][\w-]*~"
    r"|%\([\w.-]+\)[sdrf]|(?<![\w%])%(?:\d+\$)?[sdr]\b|\{[\w.:-]*\}|_{3,}"
    r"|[\[<(](?:insert|your|describe|enter|add an?|write|replace|fill|explain|why|what|todo|tbd|optional|einfügen|insérer|inserte|insira)\b[^\[\]<>()]*[\])>]", re.I)
#: Delimiters that also stand for other things (types, tags of subjects, variables of a shell).
WEAK_SLOTS = re.compile(r"<(?![a-z]+:|[^<>\s]*@)[^\W\d](?:[\w |/.-]*)>|\[[^\W\d]\w*(?:[_ -]\w+){0,3}\](?!\()|(?<![\w$])\$[A-Z][A-Z0-9_]+\b")
#: Mark-up, as far as an element is closed.
TAG = re.compile(r"</?(?:html|head|title|body|h\d|hr|br|p|div|span|noscript|center|a|b|i|em|strong|ul|li|meta|script|style|main|section|header|footer|pre|code|img|form|input|button)\b[^<>]*>|<!--|-->|<!doctype[^<>]*>|&\w+;", re.I)
CAMEL = re.compile(r"[a-z][A-Z]|\A<[A-Z][a-z0-9]*>\Z|\A<[A-Z]>\Z")
WORDS = re.compile(r"[\x00\x01]|[぀-ヿ㐀-鿿]|[^\W_]+")
FILLER_X = re.compile(r"x{2,}|(\w)\1{3,}")

_GIT = re.compile(r"\Acommit [0-9a-f]{6,64}\n(?:(?:Merge|Author|AuthorDate|Commit|CommitDate|Date):[^\n]*\n)*\n?")
_MAIL = re.compile(r"\AFrom [0-9a-f]{6,64}[^\n]*\n(?:(?:From|Date):[^\n]*\n)*Subject: ")
_PATCH = re.compile(r"\[PATCH[^\]\n]*\] ?")
_TRAILER = re.compile(r"^\s*(?:\(picked from [^)\n]*\)|\(cherry picked from [^)\n]*\)|[A-Z][a-z]+(?:-[a-z]+)*-(?:by|to|id):\s*[^{}\[\]<>$%@#\n]*(?:<[^>\n]*@[^>\n]*>)?)\s*$", re.M)
_PREFIX = re.compile(r"\A(?:[a-z]{2,10}(?:\([^()\n]*\))?!?:\s+|\[[A-Z][A-Z0-9]*-\d+\]\s+)")
_DIFF = re.compile(r"^(?:diff --git |Binary files |GIT binary patch|--- \S+\n\+\+\+ |@@ -\d)", re.M)
_HEADER = re.compile(r"^(?:diff --git|index [0-9a-f]|---|\+\+\+|(?:old|new|deleted file|new file) mode|similarity|rename|copy|dissimilarity)[^\n]*$", re.M)
_RULE = re.compile(r"^---\s*$", re.M)
_COMMENT = re.compile(r"\A\s*#(?:\s|\Z)")


def fold(text: str) -> str:
    """Without case and accents."""
    text = text.casefold()
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def phrases(text: str) -> list[str]:
    return [p for q in text.replace("\n", "|").split("|") if (p := q.strip())]


def reasons(words: int = 2) -> list[str]:
    """The reason phrases of failed HTTP requests of so many words; 2: of two or more."""
    return [s.phrase for s in HTTPStatus if s >= 400 and min(2, len(s.phrase.split())) == words]


#: Which wording has which classes; tests leave parts of it out.
WORDING: list[tuple[str, int]] = [
    (SUBJECTS, PAGE | SUBJECT), (FAILURES, PAGE | FAIL), (ACTS, PAGE | ACT), (NEGATIONS, NOT), (SCRIPTS, PAGE | SCRIPT), (COOKIES, PAGE | COOKIE), (READERS, READER), (SWITCHES, PAGE | SWITCH),
    (TELLS, PAGE | TELL), ("|".join(reasons()), PAGE | TELL | STATUS), (ERRORS, PAGE | ERROR), ("|".join(reasons(1)), PAGE | ERROR), (UPKEEP, PAGE | MAINT), (PAGE_WORDS, PAGE), (FRAMES, FRAME), (PARTS, PART | FRAME), (PROMPTS, TEMPLATE | FRAME),
    (UNSETS, UNSET | FRAME), (FILLERS, FILLER), (GLUES, GLUE), (VERBS, VERB)]


@lru_cache(4)
def automaton(wording: tuple[tuple[str, int], ...] | None = None):
    """All phrases as folded words with a blank before, and one behind if they aren't stems."""
    import ahocorasick

    a, kinds = ahocorasick.Automaton(), {}
    for text, kind in wording or WORDING:
        for p in phrases(text):
            words = " ".join(WORDS.findall(fold(p)))
            key = f" {words}" if p.endswith("*") else f" {words} "
            kinds[key] = kinds.get(key, 0) | kind
    for key, kind in kinds.items():
        a.add_word(key, (key.rstrip().count(" "), len(key), key.endswith(" "), kind))
    a.make_automaton()
    return a


class Marks:
    """The classes of each word of a text, summed up so that any stretch of it is judged in one step."""

    def __init__(self, text: str, wording=None):
        text = TAG.sub(" ", text) if "</" in text or "<!" in text or "<br" in text else text  # <title> alone is a slot
        text = SLOTS.sub(" \x00 ", text)
        text = WEAK_SLOTS.sub(lambda m: m.group() if CAMEL.search(m.group()) else " \x00 " if m.group().count(" ") > 1 else " \x01 ", text)
        self.paragraphs: list[int] = []  # words before each
        words: list[str] = []
        for p in re.split(r"\n[ \t>]*\n", fold(text)):
            self.paragraphs.append(len(words))
            words += WORDS.findall(p)
        self.words = words
        line = " " + " ".join(words) + " "
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))
        marks = [0] * len(words)
        for end, (n, length, whole, kind) in automaton(wording).iter(line):
            first = bisect_right(starts, end - length + 1) - 1
            for k in range(first, min(first + n, len(marks))):
                # The small words of a phrase take its classes; alone they have none.
                marks[k] |= kind
        for k, w in enumerate(words):
            if w == "\x00":
                marks[k] = SLOT
            elif w == "\x01":
                marks[k] = WEAK
            elif not w.isalpha():
                marks[k] = GLUE if not marks[k] & TELL else marks[k]  # a number or an identifier
            elif w[1:2] == w[0] and FILLER_X.fullmatch(w):
                marks[k] |= FILLER
        self.marks, self.all = marks, 0
        for m in marks:
            self.all |= m
        strong = PAGE | FRAME | TEMPLATE | UNSET | FILLER | SLOT | WEAK
        # Content: what is no glue, or glue within a phrase that tells.
        content = [0 if m & GLUE and not m & (TELL | TEMPLATE | STATUS) else 1 for m in marks]
        self.n = list(accumulate(content, initial=0))
        self.content, self.by = content, {}
        self.any = list(accumulate((1 if m & strong else 0 for m in marks), initial=0))
        # A status number beside a word for error.
        near = [1 if m & ERROR and any(0 <= j < len(words) and words[j].isdigit() and 400 <= int(words[j][:4]) < 600 for j in (k - 1, k + 1)) else 0 for k, m in enumerate(marks)]
        self.coded = list(accumulate(near, initial=0))

    def count(self, kind: int, a: int, b: int) -> int:
        """Content words of a class among the words a to b; of some classes small words count as well."""
        if not self.all & kind:
            return 0
        if (by := self.by.get(kind)) is None:
            small = kind in (NOT, FILLER, SWITCH, FAIL, ACT, READER)
            by = self.by[kind] = list(accumulate((1 if m & kind and (k or small) else 0 for m, k in zip(self.marks, self.content)), initial=0))
        return by[b] - by[a]

    def page(self, a: int, b: int, least: float, few: int) -> bool:
        """Whether the words a to b are a page about an error or a notice. few: content words without which classes that occur together say nothing."""
        n = self.n[b] - self.n[a]
        has = lambda c: self.count(c, a, b) > 0
        if not n:
            return False
        verb = 3 if self.marks[a] & VERB and not self.marks[a] & (SWITCH | TELL) and self.words[a:a + 2] != ["log", "in"] else 0
        if self.count(PAGE, a, b) < least * (n + verb):
            return False
        if has(TELL) or self.coded[b] > self.coded[a]:
            return True
        if n < few - has(READER):
            return False
        switched = has(SWITCH) and (has(SCRIPT) or has(COOKIE))
        failed = has(SUBJECT) and (has(FAIL) or has(NOT) and has(ACT))
        return switched or failed or has(MAINT) and n > 2

    def template(self, a: int, b: int, least: float) -> bool:
        """Whether they are a template that nobody filled in."""
        n, slots, weak = self.n[b] - self.n[a], self.count(SLOT, a, b), self.count(WEAK, a, b)
        own = slots + weak
        if own:
            framed = self.count(FRAME, a, b) + 2 * own
            if framed >= least * (n + own) and (own >= 2 and 2 * own + slots >= 0.4 * n or slots and own == n or slots and own >= 0.5 * n and not self.marks[a] & VERB):
                return True
        frame, part, prompt = self.count(FRAME, a, b), self.count(PART, a, b), self.count(TEMPLATE, a, b)
        if n and frame + own >= least * n and not self.marks[a] & VERB:
            return part >= 2 and n >= 3 or prompt >= 2 and prompt + part >= 0.4 * n or part >= 1 and prompt >= 1
        return prompt >= 2 and prompt >= 0.5 * n and frame >= least * n

    def unset(self, a: int, b: int, least: float) -> bool:
        """Whether they are a template filled with nothing."""
        n, u = self.n[b] - self.n[a], self.count(UNSET, a, b)
        return u > 0 and (u == n or u >= 2 and u >= 0.4 * n and self.count(FRAME, a, b) >= least * n)

    def filler(self, a: int, b: int, least: float) -> bool:
        """Whether they are filler: the usual Latin, what hands type without thinking, or one word for a text again and again."""
        n = b - a
        f = self.count(FILLER, a, b)
        if n < 4:
            return n > 1 and all(FILLER_X.fullmatch(w) for w in self.words[a:b])
        if f >= 4 and f >= least * n:
            return True
        if self.count(PART, a, b) + f < least * n:
            return False
        (_, k), = Counter(self.words[a:b]).most_common(1)
        return k >= 4 and k >= least * n

    def residue(self, a: int, b: int, least: float, few: int) -> bool:
        return b > a and self.any[b] > self.any[a] and (self.page(a, b, least, few) or self.template(a, b, least) or self.unset(a, b, least)) or b > a and self.filler(a, b, least)


def split_parts(text: str) -> tuple[str, str, bool]:
    """Message, what follows it in place of a diff, and whether there is a real diff (which isn't part of the two).

    A diff's header with neither a hunk nor a notice of binary files under it is no diff: what follows the header stands in its place.
    """
    b = _GIT.sub("", text, count=1)
    if len(b) != len(text):
        m = re.search(r"^(?! {4})(?=\S)", b, re.M)  # the message is indented
        if b.startswith("    ") and m:
            return (_clean(b[:m.start()]), *_instead(b[m.start():]))
    elif len(c := _MAIL.sub("", text, count=1)) != len(text):
        b = _PATCH.sub("", c, count=1)
    d = _DIFF.search(b)
    r = _RULE.search(b)
    if r and (not d or r.start() < d.start()):
        return (_clean(b[:r.start()]), *_instead(b[r.end():]))
    if d:
        return (_clean(b[:d.start()]), *_instead(b[d.start():]))
    return _clean(b), "", False


def _instead(tail: str) -> tuple[str, bool]:
    """What stands where the diff should be, and whether it is one."""
    tail = tail.strip("\n")
    if not tail.strip():
        return "", False
    if not _DIFF.match(tail):
        return tail, False
    if re.search(r"^(?:@@ -\d|Binary files |GIT binary patch)", tail, re.M):
        return "", True
    rest = _HEADER.sub("", tail).strip()
    return rest, not rest


def _clean(message: str) -> str:
    return _RULE.sub("", _TRAILER.sub("", message)).strip()


def comments_only(message: str) -> bool:
    """Whether all lines are comments of the editor's template, two at least: nobody wrote a message."""
    lines = [x for x in message.split("\n") if x.strip()]
    return len(lines) >= 2 and all(_COMMENT.match(x) for x in lines)


def residue_kind(text: str | None, least: float = COVERAGE, wording=None) -> str | None:
    """`message`, `diff` or `text` if that is residue, else None. Null and empty texts hold none."""
    if not text:
        return None
    message, instead, has_diff = split_parts(text)
    if instead and not has_diff:
        m = Marks(instead, wording)
        if m.residue(0, len(m.words), min(least, COVERAGE_INSTEAD), 2):
            return "diff"
    if not message:
        return None
    m = Marks(message, wording)
    end = len(m.words)
    if not has_diff and not instead:
        if m.page(0, end, least, 3):
            return "text"
        # Without a mark between them, the last paragraphs, however many, may stand for the diff.
        for a in reversed(m.paragraphs[1:]):
            if end - a > 1 and m.any[end] > m.any[a] and m.page(a, end, least, 3):
                return "diff"
    if comments_only(message) or m.residue(0, end, least, 4):
        return "message"
    stripped = _PREFIX.sub("", message)
    if len(stripped) != len(message) and m.all & (SLOT | WEAK | PART | TEMPLATE | UNSET | FILLER):
        m = Marks(stripped, wording)
        if m.template(0, len(m.words), least) or m.unset(0, len(m.words), least) or m.filler(0, len(m.words), least):
            return "message"
    return None


def find_residue(documents: DataFrame, text: str = "text", least: float = COVERAGE) -> DataFrame:
    """`documents` with a column `residue`: which part of the text is residue (`message`, `diff`, `text`) or null.

    Rows are handled by themselves; none is dropped or moved. A column named residue is replaced.
    """
    keep = [c for c in documents.columns if c != "residue"]
    schema = T.StructType([*(documents.schema[c] for c in keep), T.StructField("residue", T.StringType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [residue_kind(t, least) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kinds, pa.string())], names=[*b.schema.names, "residue"])

    return documents.select(*keep).mapInArrow(mark, schema)


def without_residue(documents: DataFrame, text: str = "text", least: float = COVERAGE) -> DataFrame:
    """The documents that hold none."""
    return find_residue(documents, text, least).where(F.col("residue").isNull()).drop("residue")
