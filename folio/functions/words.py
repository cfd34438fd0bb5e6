"""Word lists. Each list decides results, so it must be exactly this one."""

# Words that weighing leaves out.
TERM_STOPWORDS = """the and of to in that is was for it with as his be by on not this but are from or have an they which one you were her
all she there would their we him been has when who will more no if out do what so up into your about just should could may might shall must
had its our them than then where these those some any such only also now over very"""

# Words that a query's distinctive tokens leave out.
QUERY_STOPWORDS = """the and of to a in that is was for it with as his her be by on not this but are from or have an they which one you were
all she there would their we him been has when who will more no if out do what so up into your about just should could may might shall must
said says say i me my yes also very like such than then now"""

# Words by which English is recognised in an audit.
AUDIT_STOPWORDS = """the and of to a in that is was for it with as his be by on not this but are from or have an they which one you were her
all she there would their we him been has when who will more no if out do what so up into your about just should could may might shall must"""

# Function words by language (English, French, German, Old English).
TOKEN_STOPWORDS = {
    "en": """the and but for nor yet with from into onto this that these those than then thus thou thee they them their there where when what
which who whom whose why how all any are was were been being have has had having would could should shall will may might must can did does
doing done you your yours him her hers its our ours not now out off down over above below before after while between through during until
about against because such very more most some each few many much other another same different""",
    "fr": """les des une aux ces ses tes mes leurs votre notre que qui quoi dont où comme ainsi donc mais car puis dans sur sous pour par avec
sans vers chez entre depuis pendant avant après selon malgré sont était été être avoir ont avait fait faire elle ils elles lui leur soi cet
cette ceux celles tout tous toute toutes même très plus moins aussi encore déjà toujours jamais souvent parfois est sera seront seraient fut
furent soient""",
    "de": """der die das den dem des ein eine einen einem einer eines und oder aber weil wenn dass ob nicht auch noch schon nur mehr weniger
sehr ist sind war waren sein wird werden wurde worden haben hat hatte hatten ich mir mich wir uns unser unsere ihr ihre sie ihm ihn ihnen auf
von mit für über unter bei nach vor durch ohne gegen bis seit während diese dieser dieses diesen diesem jene jener jenes""",
    "ang": """and ond ne ac swa þonne se seo þæt þæs þæm þam þære þa þas þes þis þisne þisse þissum þys þyses ic min mine mines minne minre
minum we ure ures urum urne þu þin þines þinum þine þinre ge eow eower eowres eowrum him his hire hira heo hit on of for fram mid wið ofer
under geond þurh butan binnan ymbe wæs wæron beo beon bið biþ wile wille habban hæfde hæbbe hæfdon hafast her þær þider hider""",
}
