"""Verdicts on messages that no seed was written from: recall and precision of the classifier alone."""

import re

import pytest

from mnemora.llm import residue, verdicts

RESIDUE = [
    "JavaScript has been turned off. Switch it on to use the editor.", "Scripts are required for this widget.", "Enable JavaScript and cookies to continue", "This page uses JavaScript. Your browser either doesn't support JavaScript or you have it turned off.",
    "To use all features of this archive, JavaScript must be activated.", "Your JavaScript is off; the map cannot be drawn.", "Für diese Seite wird JavaScript benötigt.", "Ohne JavaScript funktioniert die Karte nicht.", "JavaScript est requis pour consulter ce document.", "Esta aplicación requiere JavaScript.",
    "404 - File or directory not found.", "The document you asked for is not here any more and could not be located.", "HTTP Status 500 - Internal Server Error", "502 Proxy Error", "The connection to the server was reset while the page was loading.", "ERR: could not reach the database host", "Service is unavailable. Retry in 30 seconds.",
    "Our servers are overloaded right now. Please try again in a few moments.", "We're sorry, but something went wrong.", "An error has occurred. Error code 0x80.", "The website is under maintenance and will be back soon.", "You don't have authorization to view this directory.", "Forbidden: you are not allowed to open this resource.",
    "Your login has expired. Sign in again to see this record.", "Please log in to read the full note.", "This video is unavailable.", "The link you followed may be broken, or the page may have been removed.", "Unable to fetch results: timeout exceeded.", "Request blocked: rate limit reached.", "This site can't be reached.", "Cannot display this document right now.",
    "Unhandled exception while rendering the view.", "Verbindung zum Server fehlgeschlagen.", "Die angeforderte Ressource ist nicht verfügbar.", "Es ist ein unerwarteter Fehler aufgetreten, bitte laden Sie die Seite neu.", "Sie haben keine Berechtigung, dieses Dokument zu öffnen.", "La ressource demandée n'a pas été trouvée.", "Une erreur inattendue s'est produite, veuillez réessayer.",
    "Le service est temporairement indisponible.", "Votre session est terminée, reconnectez-vous.", "El recurso solicitado no existe.", "Ha ocurrido un error, intente de nuevo más tarde.", "El servidor está sobrecargado en este momento.", "No tiene autorización para ver este documento.",
    "Insert your headline here", "Sample paragraph, to be replaced.", "This is dummy copy for the mockup.", "Add a short description here.", "Write your introduction here and delete this note.", "Placeholder: author biography", "Filler text filler text filler text", "Hier Überschrift eingeben", "Platzhaltertext, bitte ersetzen.", "Ajoutez votre description ici.", "Texto provisional, reemplazar antes de publicar.",
    "Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
]
CONTENT = [
    "We turned JavaScript off in the crawler to save memory.", "The workshop teaches JavaScript to beginners.", "Her pull request moved two scripts into the tools folder.", "The site was rebuilt without JavaScript in 2019.", "Some readers block scripts, which is why the map has a static twin.", "Unsere Skripte laufen nachts auf dem kleinen Rechner.", "Nous avons réécrit les scripts de sauvegarde en avril.",
    "A 404 in the sitemap cost us two days of crawling.", "The proxy returned 502 for ten minutes on Friday, then recovered.", "Error handling belongs at the edge of the system.", "He found the missing page behind the shelf.", "The error was traced to a faulty cable.", "Nobody noticed that the service had been down since midnight.", "If the host cannot be reached, the agent waits and retries.", "Access to the archive is restricted to members of the society.",
    "The museum denied the request for a loan.", "Permission was granted after a second hearing.", "The session began with a reading of the minutes.", "She signed in at the front desk and took a seat.", "The server brought two bowls of soup.", "Timeouts fell by a third once the pool was enlarged.", "The page about owls was moved to the birds section.", "Support for the old format ends next spring.", "The connection between sleep and memory is well documented.", "Our request was approved by the board.",
    "The database holds forty thousand letters.", "The ticket quotes the banner: something went wrong.", "Users kept seeing an access denied page, so we changed the role.", "The guide explains what to do when a session expires.", "The message about maintenance was shown too early.", "They reloaded the truck and drove on.", "Please bring your own cup to the meeting.", "Check the oil before you start the engine.", "The contact sheet lists all participants.", "Many requests for the recipe came from abroad.", "The limit of the series does not exist.",
    "Der Fehler lag in einem falschen Index.", "Die Seite wurde im Mai neu gestaltet.", "Der Dienst war am Sonntag zwei Stunden lang nicht erreichbar.", "Wer keine Berechtigung hat, wendet sich an das Sekretariat, sagte sie.", "L'erreur venait d'un mauvais réglage.", "Le service a été interrompu pendant la nuit à cause d'une panne de courant.", "La page de garde porte le nom de l'auteur.", "El error se debía a un índice equivocado.", "El servicio estuvo caído el domingo por la mañana.", "La sesión terminó con un aplauso.",
    "The placeholder tenant left the flat in June.", "We removed all dummy rows before the import.", "The sample was kept at four degrees.", "The paragraph on tides was rewritten twice.", "Add the flour, then the eggs, and stir.", "The text follows the 1611 edition.", "Here the river turns north.", "Insert the card and press the green key.", "The title of the song means farewell.", "Typesetters have used lorem ipsum since the 1960s.", "Her summary of the trial runs to nine pages.",
]

#: A second set. At first sight 24 of 30 were found and one sentence wrongly; a few seeds were added since.
RESIDUE_2 = [
    "We can't display this page because JavaScript is turned off.", "Please allow scripts in your browser to load comments.", "The player needs JavaScript.", "Cette carte ne fonctionne pas sans JavaScript.", "Schalten Sie JavaScript ein, um die Karte zu laden.", "Necesita activar JavaScript para usar el editor.",
    "Oops, that page does not exist.", "The file you requested was deleted.", "500 server error", "The connection to the database failed.", "The host is unreachable at the moment.", "Your request timed out, please retry.", "Too many login attempts. Try again later.", "You are not allowed to see this record.", "Access to this archive has been denied.",
    "Your session timed out. Please log in again.", "This service has been temporarily suspended for maintenance.", "Sorry, this content could not be loaded.", "An internal error occurred, contact support.", "Seite konnte nicht geladen werden.", "Keine Verbindung zum Server.", "Connexion au serveur impossible.", "Page non trouvée sur ce site.", "Servicio no disponible.", "No se pudo establecer la conexión.",
    "Your title here", "Text to be added later", "Replace this sample text.", "Bitte hier Text einfügen.", "Texte à remplacer avant publication.",
]
CONTENT_2 = [
    "JavaScript was designed in ten days.", "My scripts live in a folder called tools.", "The film's scripts were lost in a fire.", "The committee could not agree on a date.", "The old map is not available in print.", "The bridge was closed for maintenance until March.", "A page was torn out of the diary.", "The request for more time was denied by the judge.", "An error in the ledger led to the audit.", "He failed the exam and tried again the next year.",
    "Our server room is cooled with river water.", "The log says the page was not found, but it exists.", "When the connection drops, the client waits five seconds.", "The paper describes a placeholder syntax for templates.", "She logged in every morning at eight.", "Contact between the two tribes was rare.", "The train was temporarily moved to another track.", "Write clearly and keep each paragraph short.", "The sample size was too small.", "The notice about scripts appeared on the old portal until we fixed it.",
    "Er hat den Text gestern ersetzt.", "Die Verbindung zwischen beiden Orten ist alt.", "Der Zugang zum Archiv ist frei.", "L'accès au port est libre.", "La page est consacrée aux oiseaux.", "El texto fue escrito en 1890.", "La conexión entre los dos pueblos es antigua.", "The error message confused many readers last year.", "Visitors found the site hard to read.", "The service begins at ten o'clock.",
]

#: Written after lexicon and seeds were final; nothing was changed on account of these.
RESIDUE_3 = [
    "You must enable JavaScript in order to use this forum.", "Scripting is disabled, so the chart is not available.", "Ihr Browser unterstützt kein JavaScript.", "JavaScript doit être activé pour continuer.", "We couldn't load this page. Try refreshing.", "File not found.", "The server encountered an error and could not complete your request.",
    "Gateway timed out. Please try again in 5 minutes.", "This account has been suspended.", "Invalid request.", "Sorry, you don't have access to this folder.", "You have been logged out due to inactivity.", "The database is currently offline.", "Dieser Artikel ist leider nicht mehr verfügbar.", "Der Zugriff auf diese Seite ist nicht erlaubt.", "Cette vidéo n'est plus disponible.",
    "Erreur interne du serveur.", "La página que busca no existe.", "Tiempo de espera agotado.", "Enter your text here", "[placeholder] summary follows", "Dummy content, do not publish.", "Ihr Titel hier", "Escriba el título aquí",
]
CONTENT_3 = [
    "The plugin system is written in JavaScript and tested daily.", "A browser is a window on other people's gardens.", "The file was found under a pile of maps.", "The senate refused to vote on the bill.", "He apologized for the delay and sat down.", "The second attempt failed because the glue had not set.", "You can reach the hut on foot in an hour.", "The account of the voyage is incomplete.", "An index of names follows the last chapter.",
    "The requests were answered within a week.", "The error bars show one standard deviation.", "Permission slips are due on Thursday.", "The outage on Sunday was caused by a squirrel.", "Die Anfrage der Stadt wurde abgelehnt, weil Unterlagen fehlten.", "Der Titel des Buches ist schlecht gewählt.", "La réponse du ministre est arrivée trop tard.", "Le texte de la loi est court.", "La respuesta llegó dos días después.", "El título del cuadro es un misterio.",
    "Please find the figures in the appendix.", "The old server now runs the library catalogue.", "She wrote a short text about bees.", "The dummy on the stage wore a red hat.", "The postcard never reached its address.",
]


def kind(spark, messages):
    """Documents of one message each."""
    found = residue.find_residue(spark.createDataFrame(list(enumerate(messages)), "doc_id bigint, text string"), "doc_id", "text")
    return {x.doc_id for x in found.collect()}


@pytest.mark.parametrize(("residue_texts", "content"), [(RESIDUE, CONTENT), (RESIDUE_2, CONTENT_2)])
def test_unseen_messages(spark, residue_texts, content):
    known = {re.sub(r"\W+", " ", s.lower()) for s, _, _ in verdicts.seeds()}
    assert not [m for m in residue_texts + content if re.sub(r"\W+", " ", m.lower()).strip() in known]
    bad, good = kind(spark, residue_texts), kind(spark, content)
    assert len(bad) >= 0.9 * len(residue_texts), [m for i, m in enumerate(residue_texts) if i not in bad]
    assert len(bad) >= 0.9 * (len(bad) + len(good)), [content[i] for i in sorted(good)]


def test_messages_seen_last(spark):
    """The honest figure: see the README."""
    bad, good = kind(spark, RESIDUE_3), kind(spark, CONTENT_3)
    print("recall", len(bad), len(RESIDUE_3), [m for i, m in enumerate(RESIDUE_3) if i not in bad], "wrong", [CONTENT_3[i] for i in sorted(good)])
    assert len(bad) >= 0.7 * len(RESIDUE_3) and len(good) <= 0.2 * len(CONTENT_3)


def test_template_bears_the_verdict():
    w = verdicts.weights()
    for form, template in (("the gnarly page was not found", "the <*> page was not found"), ("0 forbidden", "0 forbidden"), ("zebra says the page was not found on monday", "<*> says the page was not found on monday")):
        assert abs(verdicts.score(form, 1.0, w) - verdicts.score(template, 1.0, w)) < 1e-9
    assert verdicts.score("the zebra ate the grass", 1.0, w) == float("-inf")
