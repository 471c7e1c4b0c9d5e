"""Training of the residue classifier: python -m quillwork.llm.residue_training DOCUMENTS.parquet

No labelled messages exist. Labels come from two sources: sentences written for the purpose (error pages, notices,
filler in several languages; and people who merely tell about such things), expanded from patterns; and the messages of
a bounded random sample of texts, labelled by rules. The rules only label: what is learned are weights of words, of
pairs of words and of form, and those alone decide afterwards, also about wordings that no rule knows.
"""

from __future__ import annotations

import json
import math
import random
import re
import sys
from collections import Counter, defaultdict

from quillwork.llm import residue

SAMPLE_TEXTS = 10_000  # bound of the sample
PATTERNS_EACH = 40  # sentences made of one pattern
EPOCHS = 6
LEAST_SEEN = 2
PAGE_WEIGHT, TOLD_WEIGHT, RULE_WEIGHT = 3.0, 6.0, 1.5

NARRATED = re.compile(
    r"\b(?:i|me|my|mine|he|she|said|says|told|tells|showed|reads|wrote|writes|typed|laughed|smiled|blushed|shrugged|funny|teach(?:es)?|asking|asked|joked|weekends|by the way|instead|ha|which made|that was that"
    r"|comment card|days|afterwards|dijo|dice|decía|sagte|stand|disait|a dit|opened with|answered with)\b|\bso we\b|\bafter (?:nine|ten|eight|dark)\b",
    re.I,
)
BOX = re.compile(r"(?:^\W*|[:>\]]\s*|\b(?:tick|check|click|select|confirm|press)\b.{0,20}\s)\bi(?:['’]|\s+a)m\s+(?:not\s+a\s+robot|human)\b", re.I)
SCRIPT = r"java\s?script|\bjs\b|\bscripts?\b|\bscripting\b|client-side"
NEED = r"\benabl|\ballow|\bturn(?:ed|ing)?\b|\bswitch(?:ed|ing)?\b|\bactivat|\bunblock|\bblock|\bdisabl|\brequir|\bneeds?\b|\bmust\b|\bonly works?\b|not (?:be )?(?:available|supported|running)|unavailable|unsupported|\baktivier|\bactiv|\bautoris|\bhabilit|\bpermit|zulassen|erlaub|\bha(?:s|ve) to\b|\bwithout\b|\bon\b|\boff\b|missing|\brefuse|\b(?:could|can) ?not\b|\bcan['’]t\b"
GRANT = r"\benabl|\ballow(?:ed|ing)?\b|\baccept(?:ed|ing)?\b|\bactivat|\bunblock|\bblocked\b|\bdisabl|\bturn(?:ed)?\s(?:\w+\s)?o(?:n|ff)\b|\bswitch(?:ed)?\s(?:\w+\s)?o(?:n|ff)\b|\brequired to\b|\baktivier|\bactiv|\bacept|\bakzeptier|\bautoris|\bhabilit|\bpermit|zulassen|erlaub"
REASON = r"bad request|unauthori[sz]ed|payment required|forbidden|not found|method not allowed|not acceptable|request time-?out|conflict|gone|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway time-?out|connection (?:reset|refused|timed out)|access denied|permission denied|rate limit exceeded|page not found|server error|unexpected token in response|unexpected error|unknown error"
SIGNALS = {
    "script": re.compile(SCRIPT, re.I),
    "need": re.compile(NEED, re.I),
    "cookie": re.compile(r"\bcookies?\b|\bgalletas\b", re.I),
    "grant": re.compile(GRANT, re.I),
    "browser": re.compile(r"\bbrowser\b|\bnavegador\b|\bnavigateur\b", re.I),
    "robot": re.compile(r"\brobot\b|\bcaptcha\b|\byou(?:'re|’re| are) human\b|\bunusual (?:traffic|activity)\b|\bchecking your (?:browser|connection)\b|\bsecurity check\b|\bprove (?:that )?you\b.{0,12}\b(?:human|person)\b|\bpress and hold\b|\bcheck(?:s|ing) your connection\b|\bkein roboter\b|\bno eres un robot\b|\bpas un robot\b", re.I),
    "status": re.compile(
        rf"^\W*(?:<h<num>>\s*)?(?:(?:http|error|code|status)\W*){{0,3}}<num>\W*(?:{REASON})\b|^\W*<h<num>>\s*(?:{REASON})\b|^\W*err_|^\W*(?:{REASON})\W*(?:(?:reference|incident|ray|id|code|error)\b.*)?$|^\W*(?:http|error)\W+(?:code\W+)?<num>|<num>\W+that['’]s an error|^\W*(?:error|error code|code)\W+<num>\W*$",
        re.I,
    ),
    "failure": re.compile(
        r"^\W*[{\[].{0,60}\b(?:error|status|exception|message)\b\W*:|something (?:went wrong|failed)|failed while|could not be (?:loaded|found|reached|displayed|processed)|(?:page|resource|file|address|listing) (?:does not|doesn['’]t) exist|requested (?:resource|page|url)|no route matches|link you followed|session (?:has|is) expired|please sign in again"
        r"|connection failed|query failed|is locked$|traceback \(most recent|^\W*file .{0,40}, line <num>|\b\w*(?:error|exception): |fatal error|parse error|exception in thread|\bat line <num>|undefined (?:variable|index|offset)|\bon line <num>|stack trace|segmentation fault"
        r"|(?:can['’]t|cannot|could not) find (?:that|this|the) (?:page|file)|may have been (?:moved|deleted|removed)|request timed out|^\W*request id\W|unable to (?:fetch|load|connect|process|display|retrieve)|(?:backend|server|upstream)\b.{0,20}\b(?:did not answer|too busy|not responding|time)|(?:down|closed|offline) for (?:scheduled )?maintenance|under maintenance|be back (?:shortly|soon)"
        r"|unavailable in your (?:region|country)|not available in your (?:region|country)|we['’]ve logged|we have logged|has not uploaded|domain is parked|\b(?:removed|deleted|deactivated|disabled) by (?:its|the) (?:owner|author|moderators?)\b|connect error|disconnect before|servers? (?:are|is) (?:having|down|busy|over)|(?:content|page|listing|site|service|feature) is (?:currently |temporarily )?(?:not available|unavailable)\b|temporarily unavailable|that['’]s an error|service unavailable|internal server error|bad gateway|gateway time-?out|rate limit exceeded|too many requests|lack permission|don['’]t have permission|not authori[sz]ed to"
        r"|access (?:to this \w+ )?(?:is )?(?:denied|blocked|restricted)\W*(?:$|reference|incident|for)|your (?:request|ip).{0,20}(?:blocked|rejected|refused)|contact (?:the|your) (?:site |system )?administrator|\b(?:erreur|fehler|error) <num>\W{1,3}\w.*\b(?:serveur|server|servidor|problème|problem|problema)\b|seite (?:wurde )?nicht gefunden|página no encontrada|page introuvable|acceso denegado|zugriff verweigert|accès refusé|algo salió mal|etwas ist schiefgelaufen|une erreur est survenue",
        re.I,
    ),
    "filler": re.compile(
        r"\bgoes here\b|\btext (?:to follow|to come|pending|here)\b|\bto (?:come|follow)\W*$|\btb[acd]\W*$|^\W*untitled\b.{0,40}$|^\W*sample (?:\w+ ){1,4}<num>\W*$|^\W*(?:enter|type|add|write|put|insert|use) your own\b|\bcontent missing\b|\bin this box\b|\bthis box holds\b|\bdouble-click to\b|\bsample description\b|\breplace (?:it|this|them) with your own\b|^\W*(?:test|dummy) (?:post|page|entry)\b|\b(?:blindtext|platzhalter|texto de relleno|texto de ejemplo|texte de remplissage|faux texte)\b|\bclick to edit\b|\bdo not publish\b|^\W*(?:placeholder|dummy|sample text|tbd|tba|todo|tk|to be (?:added|written|announced|confirmed))\b|<!--.{0,80}\b(?:pending|todo|placeholder|here|tbd)\b"
        r"|^\W*(?:add|insert|enter|write|type|put|replace)\s(?:\w+[ -]){0,6}(?:of <num> words|here|text)\b|\breplace this\b|\bcontent coming soon\b|^\W*lorem\b.{0,40}\bipsum\W*$|^\W*(?:(?:blah|asdf|qwer\w*|test|foo|bar|x{3,}|bla|xx+)\W*){3,}$",
        re.I,
    ),
}
LETTERS = re.compile(r"[^\W\d_]+")


def rule_says(message: str) -> bool | None:
    """The label of a masked message by rules: residue, not residue, or (told signals are sure negatives) None for a
    message without any signal."""
    words = [w.lower() for w in LETTERS.findall(message)]
    if len(words) >= 4 and sum(w in residue.LATIN for w in words) >= 0.6 * len(words):
        return True
    if len(words) >= 4 and len(set(words) - {"a", "the", "of"}) >= 3 and all(w in residue.PARTS for w in words):
        return True
    got = {k for k, p in SIGNALS.items() if p.search(message)}
    page = {"robot", "status", "failure", "filler"} & got or {"script", "need"} <= got or {"cookie", "grant"} <= got or ("browser" in got and re.search(r"not supported|unsupported|outdated|checking", message, re.I))
    if not page:
        return None
    return not NARRATED.search(BOX.sub(" ", message))


# patterns of what pages say; ( | ) are choices, an empty choice leaves a word out
PAGES = """(Sorry|Apologies|Oops|Uh oh|Whoops|We're sorry|Error|Hmm)(, |! |. )(something|an error|a problem|an issue) (went wrong|occurred|happened|came up)( on our end| on our side|)( while loading (this|the) page|)
(Sorry|Unfortunately|), you (have been|are|were) (blocked|banned|locked out|denied access|logged out|redirected)( from this site| by the site owner|)
(Your|The) (browser|device|web browser) is (too old|outdated|not supported|unsupported|no longer supported)( for this (site|page|app)|)
(Please|) (update|upgrade|change|switch) your browser( to (continue|a newer version|view this page)|)
(This|The|Our) (page|site|app|website|feature|content|service|video|listing|@) (requires|needs|works only with|depends on|relies on|will not work without|does not work without|cannot be shown without|only works with) (JavaScript|JS|cookies|a modern browser|scripts|scripting|WebGL)
(JavaScript|JS|Cookies|Scripts|Scripting) (is|are|seems to be|must be|needs to be|appears to be|has to be) (disabled|turned off|enabled|blocked|turned on|switched on|required|off)( in your browser| to (continue|proceed|view this page)|)
(Please|You need to|You'll need to|You must|You have to|Kindly|In order to continue,) (enable|allow|turn on|activate|unblock|accept) (JavaScript|JS|cookies|scripts|client-side scripting)( in your browser| in the settings|)( and (reload|refresh|try again)| to (continue|view|see|read|use|load|open) (this page|the site|our menu|the @)|)
(We|This site|Our site) (use|uses) cookies( to (improve|personalise) your experience|)( and need your consent|)
By (using|browsing|continuing on) this (site|website|page) you (agree to|accept) (our|the) (use of cookies|cookie policy|privacy policy|terms)
(Accept|Reject|Allow|Manage) (all|) (cookies|preferences|cookie settings)
Just a (moment|second|minute)(...| while we check your (connection|browser)|, please wait)
(Checking|Verifying) (your browser|your connection|that you are human|if the site connection is secure)( before (accessing|you continue)|)( This may take a few seconds|)
(Please|) (complete|solve|pass) the (security check|captcha|challenge|puzzle)( to (continue|access the site)|)
(Confirm|Prove|Verify|Show us) (that|) you (are|'re) (not a robot|a human|human|a real person)
(Tick|Check|Click|Select|Press|Mark|) (the box |)(I'm|I am) (not a robot|human|no robot)( to (continue|go on|proceed|verify)|)
(Our systems|We) (have|) detected (unusual|suspicious|automated) (traffic|activity|requests)( from your (network|computer|IP address)|)
(Attention|Access) (required|denied|restricted|blocked|forbidden)
You (do not|don't) have (permission|access|rights|the required permissions) to (access|view|open|edit) this (page|resource|folder|file|server)
(You are|You're) not (authorized|authorised|allowed|permitted) to (view|access|see|open) this (page|resource|content)
(Access|Request|Connection|Login|Authentication|Upload|Payment|Session) (denied|rejected|blocked|failed|refused|reset by peer|timed out|expired|forbidden|aborted)
(Your|The) (request|connection|session|login|token|link|form|payment|upload) (has|) (timed out|expired|was blocked|was rejected|failed|could not be processed|was interrupted|is invalid|has been terminated)( Please (try again|log in again|refresh the page)|)
(Please|) (try again|come back|check back|reload the page|refresh|retry)( later| in a few minutes| in <num> seconds| soon|)
(If|Should) (the|this) (problem|error|issue) (persists|continues)(, please|) (contact|notify|email) (support|the administrator|the webmaster|us)
(HTTP|Error|Status|) <num>( -|:|) (Not Found|Forbidden|Bad Request|Unauthorized|Internal Server Error|Bad Gateway|Service Unavailable|Gateway Timeout|Too Many Requests|Method Not Allowed|Gone|Request Timeout|Payload Too Large|Conflict|Teapot|Moved Permanently)
(Not Found|Forbidden|Bad Request|Unauthorized|Internal Server Error|Bad Gateway|Service Unavailable|Gateway Timeout|Page not found|File not found|Server Error|Gone)
(Error|Error code|Code|Status)( :|:|) <num>
(The|This|That) (page|file|resource|document|listing|article|link|URL|address|item|post|account|profile|image|video) (you (requested|are looking for|tried to open|followed) |)(could not be found|was not found|does not exist|doesn't exist|no longer exists|has been removed|has been deleted|has moved|is not available|is unavailable|cannot be displayed|is broken|may have been moved)( on this server|)
(We|) (can't|cannot|couldn't|could not|can not) (find|locate|load|open|display|show|reach|connect to|retrieve|process|complete|render) (the|that|this|your) (page|site|file|content|request|data|server|results|image|listing|map|menu)( right now| at this time| at the moment|)
(Nothing|No results|No content|No data|No posts|No items|No reviews|No page) (found|here|to display|to show|available|matched)( yet|)
(It looks like|Looks like|It seems) (nothing was found|this page is missing|you're lost|the link is broken|you are offline|there is no connection|you followed a bad link)( at this location|)
(The|This|Our) (site|website|page|service|server|system|app|store|platform|database) is (currently |temporarily |)(down|offline|unavailable|under maintenance|under construction|closed for maintenance|undergoing maintenance|out of service|overloaded|too busy|not responding|being upgraded)( for (scheduled|planned) maintenance|)( Please check back (soon|later)|)
(Down|Offline|Closed) for (scheduled |planned |urgent |)(maintenance|upgrades|repairs)( for <num> (minutes|hours|days)|)
We('ll| will| should) be (back|right back|back online|up again) (soon|shortly|in a moment|in <num> minutes|after the update)
(Scheduled|Planned|Emergency) maintenance (in progress|is under way|tonight|until <num>:<num>)
(Coming soon|Under construction|Site under construction|Launching soon|Work in progress|Website coming soon)
(This|The) (content|video|page|item|site|service|product) is (not available|unavailable|blocked|restricted) in your (country|region|location|area)
(This|The) domain (is for sale|has expired|is parked|may be for sale|name is registered)( by its owner|)
(This|The) (account|user|profile|store|shop|subscription|website) (has been|was|is) (suspended|deactivated|disabled|closed|terminated|banned|deleted)
(Default|Welcome to the default|Test|Index) (web page|page|site|of /)( of this server|)
(It works|Apache is functioning normally|Welcome to nginx|If you see this page, the web server is successfully installed)
(Please|You must|You need to) (log in|sign in|register|subscribe|create an account)( again|) to (continue|view this page|read more|see this content|access this page)
(Your|The) session (has|) (expired|ended|timed out)(, please| .|) (log in|sign in)( again|)
(Invalid|Missing|Wrong|Bad|Expired) (token|request|parameter|session|credentials|password|API key|certificate|argument|input|response|signature|URL)
(Rate|Request|Usage|Quota) (limit|) (exceeded|reached)(, (slow down|try again later)|)
(Too many|Unexpected number of) (requests|connections|redirects|attempts|login attempts)( from your address|)
(Fatal|Parse|Syntax|Runtime|Type|Value|Key|Null pointer|Unhandled|Uncaught|Database|Network|Unknown|Unexpected|Internal|Critical|System|Script|Template|Rendering) (error|exception|failure)(: | in | at line <num>| on line <num>|)(undefined variable|unexpected end of input|cannot read properties of undefined|call to undefined function|maximum execution time exceeded|out of memory|null reference|module not found|stack overflow|index out of range|)
(Traceback \\(most recent call last\\)|Stack trace|Segmentation fault|Core dumped|Kernel panic|Abort trap)( :|:|)
(Warning|Notice|Deprecated|Fatal error): (Undefined|Unknown|Cannot|Failed|Division|mysql_connect\\(\\)|include\\(\\)) (variable|index|offset|modify header information|to open stream|by zero|expects parameter)( in /var/www/html/index.php| on line <num>|)
(File|at) /(usr|srv|app|var)/(lib|www|src)/main.(py|js|php), line <num>
(ERROR|SQL error|Database error|mysqli_error)(: | <num> )(could not connect|connection refused|too many connections|duplicate entry|table is locked|syntax error near|query failed|deadlock found|access denied for user)( after <num> ms|)
(Failed|Unable|Could not|Cannot) (to |)(load|fetch|connect|resolve|open|parse|render|retrieve|reach|read|start|establish)( a| the|) (resource|module|script|connection|to host|file|database|config|template|response|plugin|image|upstream server|hostname)
(upstream|backend|proxy|gateway|origin|remote server|DNS|socket|SSL handshake) (connect error|timed out|did not answer|failed|returned an invalid response|is unreachable|not responding|closed the connection|reset)
({|[)( |)<quote>( |):( |)(<num>|<quote>|null|false)(, <quote>: <quote>|)(}|])
{( |)(error|status|message|code|exception|success)( |):( |)(<num>|false|null|not found|failed|denied)( |)}
ERR_(CONNECTION_REFUSED|NAME_NOT_RESOLVED|TOO_MANY_REDIRECTS|INTERNET_DISCONNECTED|CERT_INVALID|TIMED_OUT|EMPTY_RESPONSE)
(Request|Reference|Incident|Ray|Error|Event|Trace) (ID|id|number|code)(:| #|) <id>
(Your|The) (text|content|title|caption|description|headline|bio|message|name|image|quote|logo|copy) (goes|go|will go|belongs) here
(Insert|Add|Enter|Type|Write|Put|Paste|Place) (your |some |a |the |)(text|content|title|headline|description|caption|copy|paragraph|quote|bio|message|name|logo|menu|address)( here| in this box| of <num> words|)
(This is|Here is|Just) (a |some |)(sample|dummy|placeholder|example|filler|test|demo|default) (text|page|paragraph|post|content|image|entry|description|product|heading|copy)( for (layout|testing)( purposes|)|)
(Sample|Dummy|Placeholder|Example|Test|Demo|Untitled|Blank|Default) (text|page|post|title|caption|product|item|section|entry|content|image|heading|description|review|document)( <num>|)
(Placeholder|Filler|Blind text|Mock copy) (for|to be replaced by|instead of) (the|a) (second |final |real |)(paragraph|text|photo|caption|review|intro|content|article)
(Replace|Edit|Change|Delete|Swap) this (text|placeholder|paragraph|sample|image|block|section)( with your own( words|)|)
(Click|Double-click|Double click|Tap|Select|Use) (here |this |)(to|box to) (edit|add|change|replace|insert|write) (text|this text|your own text|content|title|me)
(TODO|TBD|TBA|FIXME|TK|WIP|TBC)(: | - |)(add|write|insert|text|photo|caption|intro|update|check|)( text| photo| copy| description| price| link| before launch|)
(Text|Content|Copy|Photo|Caption|Description|Details|More|Menu|Bio|Article) (to follow|to come|coming|coming soon|pending|missing|follows|to be added|to be written|to be announced|to be confirmed|not provided|unavailable)
(A |The |)@ (to come|to follow|pending|goes here|is missing|coming soon|to be added)
(To be|Will be|Yet to be) (added|written|announced|confirmed|filled in|completed|provided|determined)( soon| later|)
(Do not publish|Draft only|Draft - do not publish|Not for publication|Internal draft|For internal use only|Remove before launch)
(Hello world|Just another site|Welcome to your new site|This is your first post|Edit or delete it, then start writing)
<keys>( <keys>| test| <repeat>|)
<repeat>
(aaa|test|testing|foo|bar|baz|lorem|blah)( test| testing| foo| bar| baz| <num>| <num> <num>| ipsum| blah)
<!-- (placeholder|todo|insert|content|text|teaser|ad|image|banner|widget)( pending| goes here| here| start| end|) -->
(Loading|Please wait|Redirecting|Processing|Connecting|Buffering|Fetching data)(...| …|, please wait| you now...)
If you are not redirected( automatically|)( within <num> seconds|), (click here|follow this link)
(Please|) disable your ad(-|)blocker( to (continue|support us)|)
(This|The) (frame|embed|plugin|map|video|element|widget|iframe) (could not be loaded|is not supported|cannot be displayed|is blocked|failed to load)( by your browser|)
(Für|Um) (diese Seite|fortzufahren|die Seite anzuzeigen)(,|) (muss JavaScript aktiviert sein|aktivieren Sie bitte JavaScript|aktivieren Sie Cookies|benötigen Sie einen neueren Browser)
(Bitte|) (aktivieren|erlauben|akzeptieren) Sie (JavaScript|Cookies|Skripte)( in Ihrem Browser|)(, um fortzufahren|)
(Seite|Datei|Inhalt|Artikel) (nicht gefunden|nicht verfügbar|existiert nicht|wurde gelöscht|wurde verschoben)
(Zugriff|Anfrage|Verbindung|Anmeldung) (verweigert|abgelehnt|fehlgeschlagen|abgebrochen|unterbrochen)
(Ein Fehler ist aufgetreten|Etwas ist schiefgelaufen|Interner Serverfehler|Der Server antwortet nicht|Die Seite wird gewartet|Wartungsarbeiten|Fehler <num>)( Bitte versuchen Sie es später erneut|)
(Hier steht|Hier kommt|Dies ist) (Ihr Text|Blindtext|ein Blindtext|der Text|ein Platzhalter|Beispieltext)( hin|)
(Bitte bestätigen Sie|Bestätigen Sie), dass Sie (kein Roboter|ein Mensch) sind
(Ihr Browser wird nicht unterstützt|Ihre Sitzung ist abgelaufen|Bitte melden Sie sich erneut an|Bald verfügbar|Im Aufbau)
(Por favor|Debe|Necesita)(,|) (active|activar|habilite|habilitar|acepte|permita) (JavaScript|las cookies|los scripts)( en su navegador|)( para continuar|)
(Página|Archivo|Contenido|Recurso) (no encontrada|no encontrado|no disponible|no existe|eliminado)
(Acceso denegado|Error interno del servidor|Algo salió mal|Ha ocurrido un error|Servicio no disponible|Sitio en mantenimiento|Su sesión ha caducado|Vuelva a intentarlo más tarde|Conexión rechazada|Error <num>)( Inténtelo de nuevo|)
(Texto de ejemplo|Texto de relleno|Su texto aquí|Escriba aquí su texto|Contenido próximamente|En construcción|Próximamente)
(Confirme|Demuestre|Verifique) que no (es|eres) un robot
(Su navegador no es compatible|Actualice su navegador|Este sitio utiliza cookies|Este contenido no está disponible en su país)
(Veuillez|Vous devez|Merci d') (activer|autoriser|accepter) (JavaScript|les cookies|les scripts)( dans votre navigateur|)( pour continuer|)
(Page|Fichier|Contenu|Ressource) (introuvable|non trouvée|non disponible|indisponible|supprimé)
(Accès refusé|Accès interdit|Erreur interne du serveur|Une erreur est survenue|Une erreur s'est produite|Service indisponible|Site en maintenance|Votre session a expiré|Connexion refusée|Délai dépassé|Erreur <num>)( Veuillez réessayer plus tard|)
(Texte de remplissage|Faux texte|Votre texte ici|Texte à venir|Insérez votre texte ici|Contenu à venir|En construction|Bientôt disponible)
(Prouvez|Confirmez|Vérifiez) que vous n'êtes pas un robot
(Votre navigateur n'est pas pris en charge|Mettez à jour votre navigateur|Ce site utilise des cookies|Ce contenu n'est pas disponible dans votre pays)"""
# patterns of people who tell about such things, and of other uses of the same words
TOLD = """(Their|The) (website|site|app|page|booking page|menu page|kiosk|terminal) (was down|kept crashing|only showed an error|threw an error|asked me to enable cookies|would not load|said the page was not found|gave me a <num>|kept telling me to turn on JavaScript)(, so (I|we) (called|walked in|left|gave up)( instead|)|)
(I|We|My wife|My friend) (got|saw|had|received|kept getting) (an error|a <num> error|an access denied message|a captcha|a not found page|the spinning wheel)( on (their|the) (site|app)|)( all evening| twice| again|)(, which was (annoying|funny)|)
(I|We) (could not|couldn't) (find|reach|load|open) (the (entrance|parking lot|place|door|menu|restaurant)|their (site|page|number)|them)( at first|)
The (server|waiter|hostess|owner|cook) (was too busy|did not respond|did not answer|was not available|denied it|refused to serve us|could not be found|had moved on|had an error in the bill)( all night| to bring water|)
(The|Our) (request|order|reservation|payment|card) (was|got) (denied|rejected|refused|declined|lost|forgotten)( by the (waiter|owner)|)( without a word|)
The (kitchen|bar|terrace|pool|restroom|patio|garden) (was|is) (closed|not available|unavailable|out of service|under construction|under repair)( (when we came|last week|since May|this season)|)
(The|Their) (cookies|biscuits) (are|were) (enabled|warm|soft|dry|to die for|baked daily)
(You must|You need to|Please) try the (cookies|soup|script menu|browser burger|captcha cocktail)
(My|Our) (son|teacher|brother|neighbour) (teaches|writes|learned|fixes) (JavaScript|scripts|browsers|error messages)( on weekends| at school|)
I (told|asked|warned|reminded) the (waiter|owner|manager) that (the page was missing|the link was broken|their site was down|cookies were off|it said not found)
(They|He|She) (said|told us|explained|joked|wrote) (that |)(access was denied|service was unavailable|the system was down|they would be back soon|the menu was coming soon|we were blocked)
(Page|Chapter|Section) <num> of the (menu|wine list) is (missing|stained|not found anywhere|empty)
The (error|mistake|problem|issue) (was|is) (on the bill|fixed at once|the noise|mine)(, not theirs|)
(The cocktail|A beer|A dish|The band|The room) called (Error <num>|Not Found|Access Denied|Placeholder|Lorem Ipsum|Captcha) (is|was) (strong|great|too sweet|loud|cold)
(Service|Parking|Seating|Delivery) (is|was) (unavailable|not available|limited|slow|denied) (after nine|on Sundays|in winter|when we came)
(I|We) (waited|tried again|came back|checked back) (later|in a few minutes|after an hour|the next day)(, and (it|they) (worked|was open)|)
(We|They) (will|'ll) be back( soon| next week| for the (soup|ramen)|)
(A|The) sign (reads|said|told us) (closed for maintenance|be back soon|do not enter|no access)
(The text|The photo|The caption|The description) on (the menu|their page) (is wrong|does not match|made me laugh)
(I|We|The waiter|My son|She) (ticked|joked|said|claimed|swore|proved) that (I'm|I am|he is) (not a robot|human)( and got a table| twice|)
(As a|I work as a) (developer|web designer|tester) I (noticed|see|laugh about) (dummy text|placeholder text|the lorem ipsum|the missing title) on (their|the) (menu|page|flyer)
(Add|Put|Insert|Enter) (a|some|more) (salt|pepper|cheese|coin)( and stir| to the soup| here and there|)
(Click|Enter|Press|Tap) was the only (word|sound) (I|we) heard
(Please|) (try|order|ask for|do not miss|come for|check out) the (soup|tacos|brunch|terrace|bread|new menu)
(Coming|Opening) soon (next door|on Main Street)(, I hear|)
(This|The) (place|restaurant|shop|salon|garage|page of their history) (does not exist anymore|is under new management|has moved|no longer exists|was closed|is for sale|is not available for parties)
(Skip|Jump|Go|Back|Return) to (content|main content|footer|top|navigation|search|menu|home page)
(Home|Menu|About us|Contact|Imprint|Privacy|Search|Log in|Sign up|Share|Print|Read more|Next page|Previous page|Archive|Comments|Follow us|All rights reserved|Cookie policy|Site map)( \\| (Home|Menu|About|Contact|Search|Log in|Reviews)|)
(Subscribe|Sign up) (to|for) our newsletter
Test(ing|ed) (their|the) (patience|soup|new grill) was (fun|a mistake)
(The|This) sample (platter|menu|plate|tray) (is|was) (great|small|too salty)
(Auf der Seite|Im Internet) stand (nur ein Fehler|Seite nicht gefunden|etwas von Cookies)(, also riefen wir an|)
(Der Server|Die Bedienung|Der Koch) (war überlastet|kam nicht|antwortete nicht|war nicht verfügbar)
(La página|El sitio) (no funcionaba|daba error|decía no encontrado)(, así que llamamos|)
(Le site|La page) (ne marchait pas|affichait une erreur|demandait d'activer les cookies)(, alors on a appelé|)"""


def expanded(pattern: str, r: random.Random, words: list[str]) -> str:
    """One sentence of a pattern; @ stands for one to three ordinary words."""
    pattern = pattern.replace("\\(", "\0").replace("\\)", "\1")
    while "(" in pattern:
        pattern = re.sub(r"\(([^()]*)\)", lambda m: r.choice(m.group(1).split("|")), pattern)
    pattern = re.sub("@", lambda m: " ".join(r.choices(words, k=r.choice((1, 1, 2, 3)))), pattern)
    text = re.sub(r"\s+", " ", pattern.replace("\0", "(").replace("\1", ")")).strip(" ,")
    return text + (r.choice(("", "", ".", ".", "!")) if text[-1:].isalpha() else "")


def written_examples(seed: int, each: int, words: list[str]) -> list[tuple[str, bool, float]]:
    r, out = random.Random(seed), []
    for lines, label, weight in ((PAGES, True, PAGE_WEIGHT), (TOLD, False, TOLD_WEIGHT)):
        for line in lines.split("\n"):
            out += [(s, label, weight) for s in sorted({expanded(line, r, words) for _ in range(each)})]
    filler, parts = sorted(residue.LATIN), sorted(residue.PARTS)
    out += [(" ".join(r.choices(parts, k=r.randrange(4, 10))), True, PAGE_WEIGHT) for _ in range(5 * each)]
    out += [(" ".join(r.choices(filler, k=r.randrange(4, 18))) + ".", True, PAGE_WEIGHT) for _ in range(20 * each)]
    return out


def sampled_examples(texts: list[str]) -> list[tuple[str, bool, float]]:
    """Messages of texts, labelled by the rules; each once, ordinary ones the heavier the more texts hold them."""
    seen = Counter(m for t in texts if t for m in set(residue.messages(t)))
    out = []
    for m, n in sorted(seen.items()):
        says = rule_says(m)
        out.append((m, bool(says), 1.0 + math.log2(n) if says is None else RULE_WEIGHT if says else TOLD_WEIGHT))
    return out


def train(texts: list[str], seed: int = 7, each: int = PATTERNS_EACH, epochs: int = EPOCHS) -> dict:
    """Logistic regression by stochastic gradient (AdaGrad) with weight decay; features seen once are left out."""
    r = random.Random(seed)
    sampled = sampled_examples(texts)
    words = Counter(w for m, y, _ in sampled if not y for w in LETTERS.findall(m.lower()))
    words = sorted(w for w, n in words.items() if n > 2) or ["menu"]
    data = [(residue.tokens(m), y, weight) for m, y, weight in (*written_examples(seed, each, words), *sampled)]
    for t, y, _ in data[-len(sampled) :]:  # lines may break anywhere: parts of ordinary messages are ordinary
        if not y and len(t) > 4 and r.random() < 0.5:
            at = r.randrange(len(t) - 1)
            data.append((t[at : at + r.randrange(1, 5)] if r.random() < 0.5 else t[-r.randrange(1, 5) :], False, 1.0))
    data = [(residue.features(t), y, weight) for t, y, weight in data if t]
    seen = Counter(f for fs, *_ in data for f in fs)
    data = [([f for f in fs if seen[f] >= LEAST_SEEN], y, weight) for fs, y, weight in data]
    w, g2, bias, gb = defaultdict(float), defaultdict(lambda: 1.0), -2.0, 1.0
    for _ in range(epochs):
        r.shuffle(data)
        for fs, y, weight in data:
            z = bias + sum(w[f] for f in fs)
            step = weight * (y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            if abs(step) > 1e-3:
                gb += step * step
                bias += 0.2 * step / math.sqrt(gb)
                for f in fs:
                    g2[f] += step * step
                    w[f] += 0.2 * step / math.sqrt(g2[f]) - 2e-5 * w[f]
    return {"bias": round(bias, 3), "weights": {f: round(x, 3) for f, x in sorted(w.items()) if abs(x) >= 0.05}}


def main(path: str) -> None:
    import pyarrow.parquet as pq

    texts = pq.read_table(path, columns=["text"])["text"].to_pylist()
    m = train(random.Random(7).sample(texts, min(SAMPLE_TEXTS, len(texts))))
    residue.MODEL.write_text(json.dumps(m, ensure_ascii=False, indent=0), encoding="utf-8")
    print(len(m["weights"]), m["bias"])


if __name__ == "__main__":
    main(sys.argv[1])
