"""Verdicts on message templates: a linear classifier over concepts, fitted on labelled seed messages.

A template's words are mapped to concepts (a thing asked for, a failure, an appeal to the reader, a word that tells a
story, ...) by their stems in four languages; other words count as unknown. Features are the concepts, ordered pairs of
them, the first and the last, the length, and whether the message stands apart from running text. The weights are
fitted by logistic regression on seeds: messages of residue, and sentences that report, quote or explain such messages
or merely share their words. The seed set is fixed and bounded (SEED_LIMIT); nothing is learnt from a user's corpus here.

A message without any EVIDENCE concept is never residue, whatever its score, so such messages need no template.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np

#: Most seed messages one pattern is spelt out to, and all together.
PER_PATTERN, SEED_LIMIT = 12, 12_000

# ---- fixed values: stems by concept; `$` ends a whole word ----
CONCEPTS: dict[str, tuple[str, ...]] = {
    "script": ("jscript", "noscript$"),
    "enable": ("enable$", "enabling", "activate$", "aktivier", "activer$", "activez", "active$", "habilit", "einschalt", "allow$", "erlaub", "autorise", "permita$", "turn$", "switch$", "unblock", "schalten$", "run$", "execut"),
    "enabled": ("enabled", "allowed", "activated", "supported", "support$", "supports$", "unterstützt"),
    "need": ("need$", "needs$", "require", "necessary", "benötig", "braucht", "erforderlich", "notwendig", "nécess", "requis", "requiert", "necesi", "requier", "must$", "muss$", "müssen", "doit$", "devez", "debe$", "required$", "depends$", "relies$"),
    "off": ("disabled", "blocked", "off$", "deaktiviert", "désactiv", "desactiv", "without$", "ohne$", "sans$", "sin$", "unsupported", "switched", "turned", "ausgeschaltet", "deshabilit", "bloqué", "bloquead"),
    "browser": ("browser", "navigateur", "navegador", "cookies", "client$"),
    "thing": (
        "page$", "pages$", "seite", "site$", "website", "webseite", "node$", "knoten", "noeud", "nœud", "nodo", "note$", "notiz", "nota$", "record$", "datensatz", "document$", "dokument", "documento", "file$", "datei", "fichier",
        "archivo", "view$", "ansicht", "vue$", "vista$", "link$", "url$", "article", "artikel", "item$", "eintrag", "dashboard", "chain$", "kette", "chaîne", "cadena", "resource", "ressource", "recurso", "content$", "inhalt", "contenu",
        "contenido", "graph", "timeline", "app$", "viewer", "image$", "video$", "feed$", "profile$", "entry$", "página", "pagina", "address$", "adresse", "dirección", "data$", "daten$", "données", "datos$", "panel$", "element$", "attachment",
    ),
    "server": (
        "server", "serveur", "servidor", "service$", "dienst", "servicio", "gateway", "relais", "relevo", "backend", "upstream", "host$", "proxy", "database", "datenbank", "api$", "connection", "verbindung", "connexion", "conexión", "request$",
        "anfrage", "requête", "solicitud", "index$", "network", "netzwerk", "réseau", "system$", "cluster", "operation", "domain", "certificate",
    ),
    "fail": (
        "unavailable", "introuvable", "indisponible", "unreachable", "erreichbar", "verfügbar", "available", "disponible", "refused", "rechaz", "denied", "verweigert", "refusé", "denegad", "forbidden", "unauthori", "overload", "überlastet", "surcharg",
        "saturad", "timeout", "timed", "time-out", "fail", "error", "fehler", "erreur", "wrong$", "snag", "oops", "oups", "whoops", "hoppla", "sorry", "désolé", "leider", "lamentamos", "apolog", "inconvenience", "maintenance", "wartung", "gewartet", "mantenimiento",
        "down$", "offline", "lost$", "exception", "exceeded", "unexpected", "unable", "reset$", "crashed", "broken", "interrupted", "missing$", "invalid", "échec", "échoué", "falló", "fehlgeschlagen", "malfunction", "outage", "prohibited", "inaccessible", "schiefgelaufen", "abort",
    ),
    "expired": ("expired", "abgelaufen", "expiré", "caducad", "expirad", "out$", "ended$", "terminée", "beendet"),
    "notfound": ("found$", "find$", "gefunden", "finden$", "encontr", "trouv", "locate", "exist", "anymore", "nonexistent", "n'existe", "resolve$", "resolved$", "lives$"),
    "neg": ("not$", "no$", "nicht$", "kein", "cannot", "can't", "couldn't", "doesn't", "don't", "isn't", "wasn't", "didn't", "nothing", "nobody", "none$", "pas$", "n'a$", "n'est", "n'avez", "never$", "nichts", "rien$", "nada$", "non$", "fehlt", "lack", "won't", "could$", "could't", "impossible", "unmöglich", "imposible", "aucun", "ningun", "haven't"),
    "moved": ("moved", "removed", "deleted", "verschoben", "gelöscht", "supprimé", "déplacé", "eliminad", "retirad", "gone$", "withdrawn"),
    "load": ("load$", "loading", "loaded", "display", "render$", "rendering", "open$", "geladen", "laden$", "angezeigt", "charg", "affich", "cargar", "mostrar", "öffnen", "shown$", "show$", "process$", "complete$", "fetch$", "retrieve", "deliver", "reach", "serve$", "fulfil", "connect$", "establish", "establecer", "établir", "hergestellt", "start$", "draw$", "view$", "see$", "sehen", "ver$", "abrir", "ouvrir"),
    "answer": ("respon", "answer$", "reply", "geantwortet", "répond", "respond", "returned", "empty", "rechtzeitig", "encountered", "occurred", "occured", "condition", "happened", "aufgetreten", "produite", "produjo", "ocurrió", "ocurrid", "survenu"),
    "retry": ("again$", "retry", "later$", "reload", "refresh", "erneut", "später", "réessay", "intént", "inténtelo", "intentar", "vuelva", "tard$", "tarde$", "soon$", "shortly", "momentan", "temporar", "currently", "vorübergehend", "zurzeit", "derzeit", "gerade$", "momento", "minutes$", "minuten", "minutos", "seconds$", "moment$", "rechargez", "recargue", "actualice"),
    "please": ("please", "bitte", "veuillez", "favor$", "svp", "try$", "versuchen", "check$", "wait$", "return$", "go$", "click$", "visit$", "merci", "overprüfen", "überprüfen", "vérifiez", "compruebe", "continue$"),
    "you": ("you$", "your$", "you're", "you've", "ihr$", "ihre", "ihnen", "sie$", "vous$", "votre", "vos$", "su$", "usted", "tiene$", "this$", "diese", "cette", "esta$", "este$"),
    "signin": ("sign$", "log$", "login$", "signin", "anmelden", "melden", "reconnect", "inicie", "identifiez", "logged", "signed"),
    "session": ("session$", "sitzung", "sesión"),
    "grant": ("access$", "permission", "zugriff", "berechtig", "accès", "droit", "acceso", "permiso", "rights$", "privileges", "befugnis", "authenticat", "authoriz", "authoris"),
    "contact": ("contact$", "administrator", "administrateur", "administrador", "support$team", "webmaster", "helpdesk", "kontaktieren", "contactez", "póngase", "owner$"),
    "code": ("http$", "status$", "code$", "bad$", "internal", "requests$", "too$", "many$", "rate$", "limit$", "quota", "anfragen", "demasiadas", "trop$", "viele$"),
    "dummy": ("placeholder", "platzhalter", "dummy", "sample$", "filler", "blindtext", "beispieltext", "mustertext", "fülltext", "relleno", "provisoire", "ipsum", "lorem", "asdf", "qwer", "factice", "remplissage", "provisional", "untitled", "tbd$", "<filler>", "boilerplate", "platzhaltertext"),
    "text": ("text$", "texte", "texto", "paragraph", "absatz", "paragraphe", "párrafo", "line$", "lines$", "title$", "subtitle", "heading", "headline", "summary$", "caption", "titel", "überschrift", "titre", "título", "description", "sentence", "copy$", "zusammenfassung", "résumé", "resumen", "body$", "words$"),
    "here": ("here$", "hier$", "ici$", "aquí", "goes$", "box$", "follows$", "steht$", "folgt"),
    "edit": ("replace", "insert$", "delete$", "write$", "add$", "added$", "type$", "fill$", "ersetz", "remplac", "sustituy", "escriba", "einfügen", "publish", "publication", "publicar", "freigabe", "saisissez", "insérez", "introduzca", "edit$", "enter$", "schreiben", "löschen", "supprimez", "borre", "reemplace", "paste$", "eingeben", "filled"),
    "code_mark": ("traceback", "keyerror", "nullpointerexception", "stack$", "pool$entry", "<missing", "undefined$", "null$", "nan$"),
    "test": ("test$", "testing$"),
    "amount": ("points", "rows$", "percent", "entries", "rank$", "zeilen", "prozent", "lignes", "pour$cent", "filas", "puntos", "million", "thousand", "average", "median", "count$", "total$", "most$", "half$"),
    "past": ("was$", "were$", "had$", "did$", "wurde", "war$", "waren", "hatte", "était", "ont$", "avait", "fue$", "había", "been$", "moved$nothing"),
    "clause": (
        "because", "since$", "after$", "before$", "although", "though", "which", "why$", "who$", "until", "so$", "therefore", "while", "during", "if$", "when$", "whenever", "once$", "than$", "how$", "then$", "else$", "instead", "weil$", "dass$", "nachdem", "seit$", "als$", "damit$", "obwohl", "wenn$", "bevor$", "nach$", "warum",
        "parce", "lorsque", "après", "quand", "puisque", "avant$", "pourquoi", "si$", "dont$", "porque", "cuando", "después", "antes$", "aunque", "tras$", "que$", "qué$",
    ),
    "day": ("yesterday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "week$", "weeks$", "ago$", "morning", "overnight", "twice", "release", "version", "gestern", "woche", "montag", "lundi", "semaine", "hier$soir", "ayer", "lunes", "semana", "noche", "nuit"),
    "tell": (
        "said$", "says$", "say$", "told", "asked", "reported", "reports$", "saw$", "showed", "shows", "explain", "runbook", "ticket", "incident", "issue$", "covers", "logs$", "fixed", "restarted", "changed", "handled", "answers", "rendered", "noted", "wrote", "writes", "called", "mention", "describe", "documented", "docs$", "phrase", "wording",
        "string$", "matches", "returns", "raised", "raises", "throws", "customers", "users$", "team$", "alert", "metrics", "expected", "caught", "checks", "asserts", "verifies", "confirmed", "counts", "counted", "grew", "fell", "dropped", "rose", "improved", "rolled", "deployed", "parser", "commit$", "branch", "reviewed", "discuss", "chapter",
        "taught", "learn", "decided", "agreed", "kept", "keeps", "wants", "wanted", "prefers", "label$", "translated", "means$", "spoke", "sagte", "sagt$", "meldet", "schrieb", "zeigte", "zeigt", "antwortete", "erklärt", "handbuch", "dit$", "disait", "montre", "montrait", "affichait", "explique", "dice$", "dijo", "muestra", "mostró", "explica", "used$",
    ),
    "we": ("we$", "wir$", "nous$", "nuestr", "our$", "unser", "notre", "they$", "he$", "she$", "i$", "hemos", "on$"),
}
PASSAGE = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat "
    "duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum"
)
#: Words of the passage that are common in living languages.
ALIVE = ("in", "do", "est", "sit", "non", "ex", "et", "ad", "id", "eu", "ea", "ut", "dolor", "culpa", "magna", "qui", "esse", "sed", "labore", "sint", "tempor", "velit", "anim", "duis", "dolore")
CONCEPTS["latin"] = tuple(f"{w}$" for w in dict.fromkeys(PASSAGE.split()) if w not in ALIVE and w not in ("lorem", "ipsum"))
#: Concepts of which one at least must occur.
EVIDENCE = ("script", "latin", "fail", "expired", "notfound", "moved", "retry", "signin", "grant", "contact", "dummy", "text", "here", "edit", "code_mark", "answer", "code")
#: Concepts that are counted together.
#: Pairs of concepts that count as evidence together.
PAIRED = (("neg", "load"), ("neg", "server"), ("neg", "thing"))
ALONE = ("the zz W zz the zz", "zz zz W the zz of zz", "W zz zz zz", "the W of the zz zz", "zz was zz with a W zz", "a W zz is zz in zz", "zz zz zz zz W zz zz", "die zz W zz im zz", "le zz W est zz zz", "el zz W es zz zz")
GROUPS = {"story": ("past", "clause", "day", "tell"), "bad": ("fail", "expired", "notfound", "moved", "off", "neg"), "filling": ("dummy", "latin", "text", "here", "edit")}
ALT = {
    "ENABLE": ("enable", "activate", "turn on", "switch on", "allow", "unblock"),
    "THING": ("page", "site", "node", "note", "record", "document", "file", "view", "resource", "link", "article", "item", "content", "timeline", "graph", "dashboard", "viewer", "session list", "map view", "zz view", "zz viewer"),
    "OUR": ("the", "this", "our", "your", "the"),
    "SERVER": ("server", "service", "gateway", "backend", "upstream host", "database", "api", "memory service", "host", "proxy", "index"),
    "OFF": ("disabled", "turned off", "switched off", "blocked", "off", "not enabled"),
    "SEE": ("view this THING", "see this THING", "continue", "run this app", "load the THING", "use this site", "display the content"),
    "LEAD": ("", "", "", "sorry! ", "oops! ", "error 0: ", "error: ", "notice: ", "request failed: ", "unexpected failure: ", "0: ", "we are sorry, "),
    "LATER": ("please try again later", "try again in 0 minutes", "please come back soon", "please reload the page", "please check back later", "contact your administrator", "please wait a moment and retry"),
    "REPORT": (
        "the runbook says that", "we saw that", "users reported that", "the log showed that", "the ticket says", "the docs explain why", "she asked why", "he wrote that", "the test checks that", "the alert said", "last week", "yesterday", "the report notes that", "on monday", "according to the incident review,",
        "the client retries when", "if", "whenever", "after the release", "the article describes how", "the error message", "the team discussed why", "the reviewer noted that",
    ),
    "TAIL": (", so we re-ran it", " because the cache was cold", " on tuesday", ", and we fixed it last week", ", as issue 0 explains", ", which was expected", " while the job restarted", " until the lock was released", ", so the handler redirects old ids", " in the old version", ", and no row was lost", " before the migration", " for 0 users", " was the right answer here"),
    "PAST": ("failed", "was unavailable", "timed out", "was down for maintenance", "refused the connection", "returned an error", "was not found", "was removed", "had expired", "was denied", "threw an exception", "did not respond"),
    "HEADING": (
        "session", "summary", "quota", "minutes", "title", "error log", "access list", "permissions", "line", "limit", "status", "code", "text", "description", "write", "add", "later", "here", "answer", "response", "requests", "sitzung", "absatz", "zugriff", "minuten", "résumé", "accès", "minutes", "texte", "sesión", "párrafo", "acceso", "resumen", "texto",
        "found", "moved", "removed", "reload", "returned", "empty", "session log", "error budget", "failure modes", "retry queue", "scripts", "condition", "sample", "test", "index reset", "contact list", "owner", "maintenance plan", "timeline", "delete queue",
    ),
    "DING": ("seite", "notiz", "ansicht", "datei", "kette", "ressource"),
    "CHOSE": ("page", "note", "vue", "ressource", "chaîne"),
    "COSA": ("página", "nota", "vista", "cadena"),
}
POSITIVE = (
    # scripts must be on
    "please ENABLE jscript to SEE", "you need to ENABLE jscript to SEE", "to SEE, ENABLE jscript in your browser", "jscript is OFF in your browser", "your browser has jscript OFF", "your browser does not support jscript", "this THING requires jscript", "this THING needs jscript to run",
    "jscript is required to SEE", "jscript must be enabled to SEE", "for full functionality of this THING it is necessary to enable jscript", "it is necessary to run jscript", "ENABLE jscript to SEE", "ENABLE jscript and reload", "ENABLE jscript for this site, then refresh", "OUR THING does not work without jscript",
    "OUR THING could not start because jscript is OFF", "it looks like jscript is OFF, so OUR THING stays empty", "we need jscript to draw OUR THING", "jscript must be allowed before OUR THING can load", "a browser with jscript is required for this THING", "jscript required", "without jscript this THING cannot be shown",
    "noscript your browser does not run jscript, so the THING cannot be shown", "this app works best with jscript enabled", "jscript disabled", "jscript appears to be OFF, please ENABLE it", "we have detected that jscript is OFF", "here are the instructions how to enable jscript in your web browser", "jscript is not available",
    "bitte aktivieren sie jscript, um diese DING zu sehen", "diese DING benötigt jscript", "jscript ist in ihrem browser deaktiviert", "erlauben sie jscript und laden sie neu", "um fortzufahren, muss jscript aktiviert sein", "ohne jscript kann diese DING nicht angezeigt werden",
    "veuillez activer jscript pour afficher cette CHOSE", "cette CHOSE nécessite jscript", "jscript est désactivé dans votre navigateur", "activez jscript et rechargez", "sans jscript cette CHOSE ne peut pas être affichée",
    "active jscript para ver esta COSA", "esta COSA necesita jscript", "necesita activar jscript para ver la COSA", "es necesario activar jscript", "jscript está desactivado en su navegador", "habilite jscript y recargue", "debe habilitar jscript para continuar",
    # what was asked for could not be delivered
    "LEADthe THING you requested could not be found", "LEADwe could not find the THING you were looking for", "LEADwe could not find the THING you asked for", "LEADTHING not found", "0 not found", "0 THING not found", "LEADthis THING does not exist", "LEADthe THING you are looking for no longer exists", "LEADnothing lives at this address",
    "the requested url was not found on this SERVER", "LEADthe THING has moved or was removed", "LEADthis THING has been deleted", "LEADthis THING is no longer available", "LEADthis THING is not available right now", "LEADthis THING is currently unavailable", "LEADthis content is not available in your region",
    "access denied", "access to this THING is forbidden", "0 forbidden", "0 unauthorized", "0 bad request", "LEADyou do not have permission to open this THING", "LEADyou do not have access to this THING", "you are not authorized to view this THING", "LEADyour session has expired", "your session has run out", "this session has expired, please sign in again",
    "please sign in again", "please log in to continue", "you must be logged in to view this THING", "you have been signed out", "0 service unavailable", "0 bad gateway", "0 gateway timeout", "0 internal server error", "http error 0", "http 0 service unavailable", "http 0 - the SERVER encountered an unexpected condition",
    "LEADthe SERVER is temporarily unavailable", "SERVER temporarily overloaded", "SERVER unavailable", "LEADthe SERVER is down for maintenance", "LEADthe SERVER is offline while we carry out maintenance", "LEADthe SERVER did not answer in time", "LEADthe SERVER gave no answer in time", "LEADthe SERVER refused the connection", "LEADthe SERVER returned an empty response",
    "LEADthe SERVER returned an error", "the SERVER is not responding", "no response from SERVER", "SERVER error", "connection timed out", "connection timed out while loading this THING", "the connection was reset", "the connection was closed by the SERVER", "your request was blocked", "your request was not completed", "LEADthe THING was not found", "the THING was removed", "this THING was deleted by its owner", "an error was encountered", "please log in", "please sign in", "log in to view this THING", "something is wrong", "the THING is under maintenance", "the SERVER is under maintenance and will be back shortly", "we will be back soon", "the THING cannot be reached", "the SERVER can't be reached", "this THING isn't working", "the THING is not here any more", "the SERVER was interrupted while the THING was loading", "the connection was interrupted while the THING was loading", "placeholder: zz zz", "placeholder for zz", "ha habido un error, intente de nuevo", "nous avons rencontré un problème", "cette CHOSE ne peut pas être chargée", "diese DING konnte nicht gefunden werden", "nous sommes désolés, réessayez plus tard", "wir sind gleich zurück", "el sitio está en mantenimiento",  "the operation failed", "the operation could not be completed", "connection reset by peer", "connection lost", "connection refused", "no connection to the SERVER", "no connection", "not connected", "SERVER connection failed", "cannot connect", "access to this THING has been denied", "access has been restricted", "access is not allowed", "LEADupstream connection reset", "request timed out", "the request could not be completed", "your request could not be processed",
    "LEADsomething went wrong", "something went wrong on our side", "we hit a snag", "oops", "LEADan error occurred", "an unexpected error has occurred while processing your request", "an error occurred while loading the THING", "LEADloading this THING failed", "LEADunable to load the THING", "unable to connect to the SERVER", "failed to load THING", "failed to fetch", "failed to connect to SERVER",
    "internal error while rendering the THING", "LEADthis THING could not be loaded", "could not load THING", "this THING cannot be displayed", "could not resolve host", "LEADtoo many requests", "too many requests came from your address", "rate limit exceeded", "quota exceeded", "slow down and reload this THING in 0 seconds", "LATER", "LEADLATER", "we apologize for the inconvenience", "we are currently performing maintenance",
    "SERVER busy, LATER", "SERVER overloaded, LATER", "traceback (most recent call last): render_node failed, keyerror", "traceback (most recent call last):", "traceback (most recent call last): render_node failed, keyerror: zz", "traceback (most recent call last): zz, zz, keyerror: zz", "<missing pool entry pool-0>", "unhandled exception", "fatal error: unexpected end of input", "undefined index", "go back to the start page",
    "fehler 0: die angeforderte seite wurde nicht gefunden", "die gesuchte DING existiert nicht mehr", "DING nicht gefunden", "zugriff verweigert", "keine verbindung", "kein zugriff", "keine verbindung zum dienst", "verbindung unterbrochen", "verbindung konnte nicht hergestellt werden", "ihnen fehlt die berechtigung für diese DING", "für diese DING fehlt ihnen der zugriff", "hinweis: der dienst hat nicht rechtzeitig geantwortet", "der dienst ist vorübergehend nicht erreichbar",
    "der server wird gerade gewartet", "diese DING ist zurzeit nicht verfügbar", "ihre sitzung ist abgelaufen", "bitte melden sie sich erneut an", "bitte versuchen sie es später erneut", "versuchen sie es in 0 minuten erneut", "es ist ein fehler aufgetreten", "etwas ist schiefgelaufen", "da ist etwas schiefgelaufen", "leider konnte die DING nicht geladen werden", "zu viele anfragen", "der server ist überlastet",
    "erreur 0 : la page demandée est introuvable", "cette CHOSE n'existe plus", "CHOSE introuvable", "accès refusé", "connexion impossible", "connexion au service impossible", "CHOSE non disponible", "CHOSE non trouvée", "impossible d'établir la connexion", "vous n'avez pas le droit d'ouvrir cette CHOSE", "désolé: vous n'avez pas accès à cette CHOSE", "le serveur n'a pas répondu à temps", "service momentanément indisponible", "le serveur est en maintenance", "cette CHOSE est indisponible pour le moment",
    "votre session a expiré", "veuillez vous reconnecter", "réessayez plus tard", "réessayez dans 0 minutes", "une erreur est survenue", "un problème est survenu", "une erreur s'est produite", "impossible de charger la CHOSE", "trop de requêtes", "le relais a refusé la connexion",
    "error 0: no se encontró la página solicitada", "esta COSA ya no existe", "COSA no encontrada", "acceso denegado", "sin conexión", "no hay conexión con el servidor", "no se pudo establecer la comunicación", "COSA no disponible", "no tiene permiso para abrir este nodo", "no tiene acceso a esta COSA", "el servidor no respondió a tiempo", "el servicio no está disponible en este momento", "el servicio está en mantenimiento", "esta COSA no está disponible por ahora",
    "su sesión ha caducado", "su sesión ha expirado", "inicie sesión de nuevo", "inténtelo más tarde", "vuelva a intentarlo en 0 minutos", "se produjo un error", "ocurrió un error inesperado", "no se pudo cargar la COSA", "demasiadas solicitudes", "el relevo rechazó la conexión", "el servidor rechazó la conexión",
    # filler and dummy text
    "placeholder paragraph", "placeholder text", "this is placeholder text", "this is a placeholder", "dummy text", "this is dummy text for the layout", "sample text", "sample text sample text", "sample text goes here", "your text here", "your content goes here", "text will be added later", "content goes here", "insert text here", "type your text here",
    "add your text here", "enter a description here", "write the summary of this THING here", "replace this paragraph before publishing", "replace this text with your own", "delete this line", "delete this paragraph and write your own", "title goes here", "title of the THING", "subtitle of the THING", "two or three lines about the THING go in this box", "click here to edit this text", "description goes here",
    "a short summary of the THING goes here", "asdf asdf qwer test", "asdf qwer asdf", "test test test", "lorem ipsum", "lorem ipsum dolor sit amet", "consectetur adipiscing elit, sed do eiusmod tempor incididunt", "ut enim ad minim veniam, quis nostrud exercitation ullamco", "excepteur sint occaecat cupidatat non proident", "duis aute irure dolor in reprehenderit in voluptate", "<filler> <filler> <filler>", "<filler> <filler> <filler> <filler> <*> <filler>", "filler text", "untitled document", "headline goes here", "fill in the description", "text follows",
    "hier steht später ihr text", "bitte diesen absatz ersetzen", "blindtext blindtext blindtext", "beispieltext, wird vor der freigabe ersetzt", "platzhalter für den text", "ihr text hier", "hier text eingeben", "titel hier einfügen", "mustertext", "dieser text wird noch ersetzt",
    "votre texte ici", "remplacez ce paragraphe avant la publication", "texte provisoire", "texte de remplissage", "saisissez votre texte ici", "insérez le titre ici", "titre à remplacer",
    "escriba aquí su texto", "sustituya este párrafo antes de publicar", "texto de relleno", "su texto aquí", "inserte el título aquí", "texto provisional", "añada aquí la descripción",
)
NEGATIVE = (
    # headings and pieces of lines
    "HEADING", "zz HEADING", "zz HEADING", "zz zz HEADING", "HEADING zz", "the HEADING", "notes on the HEADING", "zz turned empty", "the THING turned empty", "zz returned the THING at rank 0", "zz returned zz", "recall returned", "recall returned the SERVER", "returned the SERVER at", "lost", "lost 0", "lost 0 points of zz", "zz lost 0 points", "zz SERVER", "zz THING", "note: the zz zz the SERVER; see note-0 for the zz SERVER", "note: the summary zz the zz; see entry 0 for the zz session", "that is zz and keeps the complete zz in zz and not next to the SERVER", "see zz for the empty zz", "menu", "home", "run it like this: code and the THING is found", "and the THING is found", "run it like this", "the zz graph lost 0 points of zz", "a zz THING zz zz during the zz, and the zz moved nothing else", "note: the zz moved the zz; see note-0 for the zz SERVER", "since the zz entry appended twice, zz moved its THING behind the zz", "graph lost 0 points of relevance", "summary in zz and not next", "the summary is found in zz",
    # reports of such messages: REPORT or TAIL around a message, made by rule in seeds(), and these
    "we saw 0 bad gateway answers for 0 minutes while it restarted, and no row was lost", "the THING no longer answers with 0 not found, because the handler redirects old ids", "access denied was the right answer here: it had no grant for the THING, as issue 0 explains", "the panel works with jscript disabled since the list is rendered on the server",
    "the help text says code; we want a friendlier line in the THING", "she asked why the mock generator writes lorem ipsum; we now feed it recorded sittings instead", "the note template has a slot called greeting; we reviewed the wording and are happy with it", "the renderer fills code from the record before a note is saved, and a test covers it",
    "the SERVER PASTTAIL", "the request to the SERVER PASTTAIL", "when the SERVER PAST, the job was restarted", "we enabled jscript in the test runner", "our tests run with jscript OFF", "the bundle needs jscript on the build machine, so we installed it", "the jscript parser was rewritten last week", "we moved the jscript files to another folder", "jscript errors fell after the release",
    "the error rate fell to 0 percent", "the error budget was spent on monday", "error handling was reviewed", "the retry queue failed twice before the fix", "the SERVER was moved to another rack", "the record was removed after review", "the connection pool holds 0 connections", "when a request times out, the client retries", "if the session expires, the token is renewed",
    "the SERVER returns 0 forbidden for unknown tenants", "the api answers with 0 not found if the id is unknown", "the parser does not support comments", "you can find the THING in the menu", "please review the plan before friday", "we need more data to draw the graph", "your browser shows the THING faster now", "the THING loads in 0 seconds", "page requests rose by 0 percent",
    "we could not find a reason for the drift", "nobody found the old THING", "nothing was lost", "the cause was not found until week 0", "the team is not available on friday", "the new index is available now", "no permission was needed", "access to the archive was granted", "the ticket was closed again", "we tried again later and it passed", "the test failed", "two tests failed on the branch", "the build is broken since tuesday",
    "maintenance of the index takes 0 minutes", "the maintenance window is planned for sunday", "we plan to reload the index later this week", "the session lasted 0 minutes", "after each session the summary is stored", "the session ended well and the notes were filed", "the sign in form has a new label", "the login page got a new header", "the owner was asked to sign the form",
    "we replaced the paragraph in chapter 0", "the title of the report was changed", "the text describes how the cache works", "the summary was written by hand", "each line holds one record", "the placeholder in the form was renamed", "we use dummy data in the tests", "the sample holds 0 rows", "the sample text in the manual was shortened", "a text of 0 words was added to the corpus",
    "the word lorem comes from a mangled dolorem", "printers have used filler text for centuries", "el dolor no fue culpa de nadie", "the magna carta was signed in zz", "the consequat clause was struck from the draft in week 0", "the description of the field is kept short", "write tests before the code", "add the rows to the table and delete the old ones", "insert the row, then update the index", "here the list is sorted by rank", "the box holds 0 entries", "operator note: the channel folded the loop; see the matrix",
    "recall returned the THING at rank 0 although the marker had been blocked", "after 0 ticks the counter archived a broad bridge and the THING stayed final", "nobody blocked the calm memo, so it kept the curious label for another 0 minutes", "it blocked 0 entries while the lantern waited for the neighbor", "nothing restored the transcript overnight; the channel lost 0 points of relevance",
    "decision: the thread gets rejected at 0 percent, the schedule stays as it is", "open question: should the log be archived whenever the transcript gets stable", "it took 0 sittings until the batch detached its THING", "both the token and the chain in case 0 are fresh as of week 0", "the second entry patched the first one, then cleared the context by hand",
    "for now a local label matters more than the THING that the note collapsed", "we deferred the buffer because its THING looked cautious next to the field", "when issue 0 was folded, the cache turned dated", "the stream now capped 0 of 0 rows, most of them from the rough fragment", "we skipped 0 entries while the cache waited for the snapshot", "the THING asked for the summary and doubled both",
    "we turned jscript off for the zz run", "jscript is taught in zz", "zz learned jscript in school", "the zz was written in jscript", "the THING was rebuilt with jscript", "the THING was zz without jscript in 0", "zz block jscript on their phones", "nos jscript sont relancés la nuit", "unsere jscript laufen am morgen",
    "the zz denied the zz a loan", "the zz forbidden fruit", "the limit of the zz exists", "the zz of requests came from zz", "many requests for zz came from zz", "the message about zz was shown too early", "der fehler lag in einem zz zz", "el error se debía a un zz", "l'erreur venait d'un zz zz", "the text follows the edition of 0", "here the zz turns north", "the zz error was traced to a zz zz",
    "the THING on zz was moved to the zz section", "the zz found the zz behind the zz", "the zz sent a reply", "zz wrote a text about zz", "add the zz, then the zz", "the zz is open until 0", "please bring your zz to the zz", "check the zz before you start the zz", "the zz returned to the zz", "zz returned with a zz answer", "the SERVER brought zz zz", "die DING wurde im zz neu gestaltet",
    "we moved", "we moved the zz", "we moved the deadline", "es bleibt offen, ob der zz noch einmal verschoben wird", "es bleibt offen, ob der THING noch einmal gelöscht wird", "decision: the summary gets replaced at 0 percent, the zz stays", "refreshed together", "minutes", "minutes of the meeting", "they reloaded the zz and left", "he failed the zz and tried again", "the zz failed again in 0", "operator note: the zz replaced the summary; see entry 0 for the zz zz", "in zz the quota and the quota were zz together, which left the index zz", "the zz record in zz and not zz zz zz", "the zz switched the zz off to save zz",
    "home | notes | sign in", "status: open", "status code of the last run", "internal links are checked weekly", "too many cooks", "many requests come from batch jobs", "bad rows are moved to a side table", "the limit is 0 rows", "offline training starts at 0", "the down stream job reads the table", "set to 0, one rack after", "wrong answers were counted twice", "the wrong key was used in the join",
    "die seite lädt jetzt schneller", "der fehler wurde gestern behoben", "der dienst wurde am montag neu gestartet, weil der speicher voll war", "die notiz ist gelöscht; der graph folgt später", "die sitzung dauerte 0 minuten", "wir haben den absatz im handbuch ersetzt", "der zugriff wurde nach der prüfung erteilt", "die anfrage war nach 0 sekunden beantwortet", "nach 0 schritten war der bericht angehoben und die schmale spur blieb liegen",
    "in der regel sagt das log nur, dass die DING nicht gefunden wurde", "das handbuch erklärt, warum der zugriff verweigert wird", "wenn die sitzung abgelaufen ist, holt der client ein neues token",
    "la page se charge plus vite", "l'erreur a été corrigée hier", "le service a été relancé lundi parce que la mémoire était pleine", "la session a duré 0 minutes", "nous avons remplacé le paragraphe du manuel", "l'accès a été accordé après la revue", "la note dit que le stock sera corrigé la semaine 0", "le journal montrait que la page était introuvable", "le guide explique pourquoi l'accès est refusé", "quand la session expire, le client demande un autre jeton",
    "la página carga más rápido ahora", "el error fue corregido ayer", "el servicio fue reiniciado el lunes porque la memoria estaba llena", "la sesión duró 0 minutos", "hemos sustituido el párrafo del manual", "el acceso fue concedido después de la revisión", "la nota dice que el margen será cerrado en la semana 0", "el registro mostró que la página no fue encontrada", "la guía explica por qué se deniega el acceso", "cuando la sesión caduca, el cliente pide otro token", "queda por ver si el cajón debe ser anotado", "zz cuenta 0 filas, con un archivo zz ya zz", "zz compte 0 lignes, dont un fichier zz déjà zz", "zz meldet 0 zeilen, davon ist die zz notiz schon zz", "link in zz and not", "zz node in zz and not", "the cluster now refreshed 0 of 0 rows, most of them from the empty zz", "recall returned the summary at rank 0 although the zz record had been moved",
)
# ---- end of fixed values ----

WILDCARD = "<*>"


@lru_cache
def stem_pattern(concepts: tuple[str, ...] | None = None) -> str:
    """Regular expression that matches a word of the concepts (of all, by default) from its begin; stems share their first letters."""
    wanted = sorted({s.replace("$", "\0") for c in concepts or CONCEPTS for s in CONCEPTS[c] if "$" not in s[:-1]})

    def trie(words: list[str]) -> str:
        if "" in words:
            return ""
        heads: dict[str, list[str]] = {}
        for w in words:
            heads.setdefault(w[0], []).append(w[1:])
        parts = [(r"(?![\p{L}\p{N}_])" if h == "\0" else re.escape(h)) + trie(rest) for h, rest in heads.items()]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return trie(wanted)


@lru_cache
def _tables() -> tuple[dict[str, str], dict[str, str]]:
    """Whole words and stems with their concept; of several concepts the first named."""
    whole: dict[str, str] = {}
    stems: dict[str, str] = {}
    for c, words in CONCEPTS.items():
        for w in words:
            if "$" in w[:-1]:
                continue
            (whole if w.endswith("$") else stems).setdefault(w.rstrip("$"), c)
    return whole, stems


@lru_cache(maxsize=100_000)
def concept(word: str) -> str | None:
    """Concept of a word: as a whole, else by its longest stem."""
    whole, stems = _tables()
    w = word.strip(".,;:!?…()[]\"'“”„«»*_|/-=+#")
    if "_" in w:
        return None
    if w.startswith("<") and w.endswith(">"):
        w = w if w in whole or w in stems else w.strip("<>/")
    if w in whole:
        return whole[w]
    return next((stems[w[:i]] for i in range(len(w), 1, -1) if w[:i] in stems), None)


def features(template: str, apart: float) -> set[str]:
    """Names of the features a template has."""
    words = template.split()
    seq = [c for c in map(concept, words) if c]
    unknown = len(words) - len(seq)
    out = {f"has {c}" for c in seq}
    out |= {f"pair {a} {b}" for i, a in enumerate(seq) for b in seq[i + 1 :]} if len(seq) <= 40 else set()
    if seq:
        out |= {f"first {seq[0]}", f"last {seq[-1]}"}
        if words and concept(words[0]):
            out.add(f"begins {seq[0]}")
    if words and words[0].rstrip(":") == "0":
        out.add("begins with a number")
    out.add("long" if len(words) > 16 else "middle" if len(words) > 8 else "short" if len(words) > 3 else "tiny")
    out |= {f"{k} {min(3, sum(c in g for c in seq))}" for k, g in GROUPS.items()}
    out.add("unknown many" if unknown > 6 else "unknown some" if unknown > 2 else "unknown few" if unknown else "unknown none")
    out.add("mostly unknown" if 2 * unknown > len(words) else "mostly known")
    if words and (seq.count("dummy") + seq.count("latin")) * 2 >= len(words):
        out.add("mostly dummy")
    if apart >= 0.5:
        out.add("apart")
    return out


def _spell(pattern: str, rng: random.Random) -> list[str]:
    """A pattern with its alternatives chosen, several times."""
    found = set()
    for _ in range(PER_PATTERN):
        text, before = pattern, None
        while text != before:
            before = text
            for k in ALT:
                if k in text:
                    text = text.replace(k, rng.choice(ALT[k]), 1)
        found.add(text)
    return sorted(found)


def seeds() -> list[tuple[str, bool, bool]]:
    """Labelled messages: text, whether it stands apart, whether it is residue."""
    rng = random.Random(11)
    good = [s for p in POSITIVE for s in _spell(p, rng)]
    told = [t for p in NEGATIVE for t in _spell(p, rng)]
    for p in POSITIVE:
        said = _spell(p, rng)
        for form in ("REPORT @", "REPORT @TAIL", "@TAIL", "REPORT '@'TAIL"):
            told.append(_spell(form, rng)[0].replace("@", rng.choice(said)) if form != "@TAIL" else rng.choice(said) + rng.choice(ALT["TAIL"]))
    # one such word among others that mean nothing here
    for c in EVIDENCE:
        words = [w[:-1] for w in CONCEPTS[c] if w.endswith("$") and "$" not in w[:-1]] or [w for w in CONCEPTS[c] if len(w) > 5]
        for _ in range(PER_PATTERN * 3):
            told.append(" ".join(rng.choice(words) if x == "W" else x for x in rng.choice(ALONE).split()))
    rows = [(s, rng.random() < 0.8, True) for s in good] + [(s, rng.random() < 0.6, False) for s in told]
    return rows[:SEED_LIMIT]


@lru_cache
def weights() -> dict[str, float]:
    """Weights of the features, fitted on the seeds with equal weight for both classes; ridge penalty, gradient steps with momentum."""
    rows = seeds()
    sets = [features(s, float(a)) for s, a, _ in rows]
    names = sorted(set().union(*sets))
    at = {n: i for i, n in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1), np.float32)
    x[:, -1] = 1
    for i, s in enumerate(sets):
        x[i, [at[n] for n in s]] = 1
    y = np.array([r[2] for r in rows], np.float32)
    per = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum()).astype(np.float32)
    w, m, v = np.zeros(x.shape[1], np.float32), 0.0, 0.0
    for t in range(1, 601):
        g = x.T @ (per * (1 / (1 + np.exp(-(x @ w))) - y)) + 2e-5 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return dict(zip([*names, "bias"], map(float, w), strict=True))


def is_filling(template: str) -> bool:
    """Whether residue is filler rather than a message of failure."""
    seq = [concept(x) for x in template.split()]
    return sum(c in GROUPS["filling"] for c in seq) > sum(c in GROUPS["bad"] or c == "script" for c in seq)


def score(template: str, apart: float, w: dict[str, float]) -> float:
    """Log odds that a template is residue; -inf without evidence."""
    f = features(template, apart)
    if not any(f"has {c}" in f for c in EVIDENCE) and not any(f"has {a}" in f and f"has {b}" in f for a, b in PAIRED):
        return float("-inf")
    return w["bias"] + sum(w.get(n, 0.0) for n in f)
