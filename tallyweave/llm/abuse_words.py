"""Fixed values of the abuse classifier: words by class, look-alike characters, seed sentences."""

# Characters that look like Latin letters, and signs that are used for letters.
CONFUSABLE = ("аеорсухіјѕһԁԛԝвнкмтαεοριτυνκ", "aeopcyxijshdqwbhkmtaeopituvk")
LEET = ("0134578$@!|+", "oieastbsaiit")

# Word classes.
INSULTS = """
idiot moron imbecile cretin dimwit halfwit nitwit fool dumbass jackass asshole arsehole bastard bitch whore slut pig swine scum vermin parasite trash rat loser shithead dickhead motherfucker
wanker twat prick cunt douchebag scumbag lowlife clown retard filth maggot cockroach dog leech creep
arschloch drecksack drecksacke hurensohn wichser vollidiot trottel schwein missgeburt dummkopf schlampe fotze spast versager
connard connasse salope salaud abruti encule debile cretine pute imbeciles ordure merdeux
imbecil gilipollas cabron pendejo idiota estupido puta hijoputa maricon basura escoria subnormal tonto
"""
ADJECTIVES = """
stupid worthless pathetic useless filthy disgusting braindead clueless dumb brain-dead ugly miserable ignorant incompetent brainless rotten
dumm dumme dummer dummes nutzlos widerlich verdammt verdammter dreckig erbarmlich nul nulle inutile sale degueulasse inutil asqueroso sucio patetico
"""
SWEARING = "fuck fucking fucker shit bullshit damn crap hell piss verpiss fresse scheiss scheisse kacke putain merde foutre bordel mierda joder cono carajo verga"
SEXUAL = """
sex sexy nude naked nudes tits boobs breasts nipples cock dick pussy penis vagina blowjob blowjobs handjob porn porno p0rn cum orgasm moaning horny erotic hardcore anal lick licked licking
undressed thrust naughty masturbate masturbating nackt titten schwanz ficken geil nue nues seins bite desnuda desnudo tetas polla follar
"""
YOU = "you your yours yourself u ur youre you're du dich dir dein deine deiner deinen euch ihr tu te toi ton ta tes vous votre vos usted ustedes ti tus eres"
GROUPS = """
women men woman foreigners immigrants refugees migrants muslims jews christians hindus atheists catholics blacks whites asians africans arabs mexicans germans french americans chinese indians turks poles gypsies
gays lesbians homosexuals transsexuals queers disabled elderly cripples boomers teenagers
frauen auslander fluchtlinge muslime juden etrangers femmes musulmans juifs mujeres extranjeros inmigrantes musulmanes judios
"""

# Frames of plain sentences; words in capitals stand for the words of a class.
FRAMES_BAD = """
you are a ADJ INSULT
you INSULT
you ADJ INSULT
what a ADJ INSULT you are
he is such a INSULT
they are all INSULT
SWEAR you INSULT
SWEAR off
SWEAR you
SWEAR yourself
i hate you ADJ INSULT
you are so ADJ
shut up INSULT
i will kill you
i am going to hurt you
you should die
kill yourself
GROUP are INSULT
all GROUP are ADJ
i hate GROUP
GROUP do not belong here
get rid of all the GROUP
GROUP should be shot
i want to SEX you
show me your SEX
her SEX SEX body
SEX SEX video
"""
FRAMES_FINE = """
this is a ADJ bug
the code is ADJ
my ADJ mistake
i am ADJ
i was a INSULT to write this
SWEAR the build is broken
what the SWEAR is this number
i hate this api
kill the child process
the thread is killed after a timeout
the column SEX has three values
SEX is a name in this list
the INSULT flag is in the table
the INSULT command prints a list
GROUP are counted in the survey
GROUP see another label
the setting for GROUP is new
you are right thank you
you are welcome
you broke the build
could you fix this please
the old ADJ test is gone
"""
