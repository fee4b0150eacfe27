"""Labelled sentences that the classifier starts from, and the identity terms that are swapped.

Reviewed documents are few, noisy and long; a few plain sentences per kind of abuse, and as many neutral
uses of the same words, tell the classifier where in a document to look.
"""

#: Groups of interchangeable identity terms; a swap stays inside its group.
IDENTITY = (
    ("women", "men", "girls", "boys", "people", "children"),
    ("muslims", "jews", "christians", "hindus", "atheists", "catholics", "buddhists"),
    ("immigrants", "refugees", "foreigners", "migrants", "natives", "neighbours"),
    ("black", "white", "asian", "african", "arab", "latino", "european"),
    ("gay", "straight", "lesbian", "trans", "bisexual"),
    ("frauen", "männer", "muslime", "juden", "christen", "ausländer"),
    ("femmes", "hommes", "musulmans", "juifs", "chrétiens", "étrangers"),
    ("mujeres", "hombres", "musulmanes", "judíos", "cristianos", "extranjeros"),
    ("mulheres", "homens", "muçulmanos", "judeus", "cristãos", "estrangeiros"),
)

#: Insults, threats, degradation, group hatred and explicit sexual content.
ABUSIVE = """\
you are a stupid idiot
you are such a moron and a loser
you idiot, get lost
shut up, you stupid bastard
you are all ugly idiots
you brainless cow
he was a stupid pig and a filthy liar
everybody hated that worthless idiot
what a disgusting fat pig
look at that ugly face, makes me want to puke
you pathetic clown, nobody likes you
you retard, go away and die
that piece of shit is a liar
this idiot is too dumb to read
fuck you and your family
fuck this page and fuck all of you
fuck off, asshole
your mother is a whore
your mother should have drowned you at birth
go kill yourself
go hang yourself, you piece of garbage
die in a ditch, you bitch
i will kill you
i will find you and cut your throat
i will come to your house and burn it down
watch your back, tomorrow you die
you will beg me to stop
you will bleed for this
someone should strangle you
someone ought to drown her and her whole family
nobody would miss him if somebody killed him
throw them all into the river
we should burn their homes with them inside
they should all be shot
women are sluts
all women are whores and their men are thieves
immigrants are vermin and should be wiped off the map
muslims are animals, not humans
foreigners breed like rats and steal like rats
never trust jews, they are rats
no country should let refugees in, they are animals
gay people are disgusting and should be killed
they are subhuman scum
she is a slut who sleeps with everyone
she is a whore who spreads her legs for everyone
he fucked her hard on the table
he pulled down her panties and fucked her
she sucked his dick until he came
she moaned as his hard dick slid inside her
she rode him naked until they both came
lick my balls
suck my dick
send nudes, he wanks to anything
free porn, watch naked girls fuck on camera
caught in the bathroom with his trousers down, moaning like a pig
i know where you live and i will break your bones
i will break every bone in your body
i will smash your face in
i hope you get cancer and die slowly
kick them out before their filthy kids outnumber ours
immigrants should go back to their caves
go back to where you came from, you filthy animals
they have no brains, it is in their dirty blood
black people have no brains, that is a fact
gas them all
women like you belong in the kitchen on their knees
women belong on their knees, not in an office
horny girls show their tits and wet pussy
hot horny wives, wet pussy all night long
she showed her tits and he came on her face
he touched himself and moaned
that is so dumb it hurts to read, you idiot
the admin here is a total idiot and a filthy liar
whoever wrote this is a stupid pig and should never touch a keyboard again
only a retard could write such garbage
ugly bitch, ugly bitch, that is all she ever was
worthless piece of shit, that is all you ever were
she loves to suck his cock
he loves to suck cock behind the house
the only good immigrant is a dead one
the only good jew is a dead one
people like you are a waste of air
cripples are a waste of air
someone should drown that whole inbred family
they are all inbred idiots
i hope you all die, you bastards
you absolute loser, get lost
you absolute ugly bitch, die in a ditch
nobody would miss you if somebody strangled you, brainless cow
du bist ein dummes arschloch
die frauen da sind alle schlampen
ausländer sind dreck und sollen verschwinden
wir wissen wo du wohnst, du stirbst
zeig deine titten, du schlampe
tu vas crever, sale chienne
les étrangers sont des ordures, il faut les chasser
montre tes seins, salope
los extranjeros son basura y hay que echarlos a palos
las mujeres son todas putas
te vamos a romper la cara, imbécil
os estrangeiros são lixo e deviam desaparecer
as mulheres são todas putas
vamos quebrar a tua cara, idiota
mostra as mamas, vadia
du arsch
halt die fresse, du idiot
halt dein maul, du dumme kuh
ihr seid alle idioten
du hurensohn, verpiss dich
verrecke, du stück scheisse
ich bringe dich um
ausländer sind ungeziefer und gehören vergast
die sind ungeziefer und sollen verschwinden
fick dich
tu es un gros connard
vous êtes tous des imbéciles
ferme ta gueule, sale con
ta gueule, espèce de vache
va te faire foutre, pute
je vais te tuer
nique ta mère
les étrangers sont de la vermine
eres un idiota y un hijo de puta
cállate la boca, vaca asquerosa
ojalá os muráis todos, cabrones
cállate, zorra de mierda
sois todos unos imbéciles
vete a la mierda, cabrón
te voy a matar
los extranjeros son ratas
que te jodan, puta
você é um idiota
cala a boca, sua vaca nojenta
vai tomar no cu, filho da puta
vocês são todos uns imbecis
vou te matar, desgraçado
os estrangeiros são ratos
é um burro e um merda
sei un idiota e un pezzo di merda
stai zitta, brutta troia
vaffanculo, stronzo
gli stranieri sono feccia, via tutti
je bent een domme klootzak
hou je bek, vuile hoer
jesteś głupim idiotą
zamknij się, ty głupia kurwo
sen bir aptalsın, orospu çocuğu
kapa çeneni, gerizekalı
ты тупой идиот
заткнись, тупая сука
иди на хуй, мудак
вы все дебилы и уроды
я тебя убью, тварь
приезжие это мусор, их надо гнать
всех этих тварей надо убивать
сдохни, мразь
你是个白痴
傻逼
你这个傻逼
去死吧，贱人
滚开，蠢货
你们都是垃圾
操你妈
我要杀了你
外国人都是垃圾，滚出去
お前は馬鹿だ
死ね、クズ
うざい、消えろ、ブス
殺してやる
外国人はゴミだ、出て行け
너는 멍청한 새끼야
닥쳐, 병신
죽어라, 개새끼
외국인은 쓰레기다
أنت غبي حقير
اخرس يا كلب
سأقتلك يا حيوان
الأجانب قذارة
אתה אידיוט מטומטם
תסתום את הפה, זבל
तू बेवकूफ कुत्ता है
चुप रह कमीने
मैं तुझे मार डालूंगा
"""

#: Neutral uses of the same words: reports, quotations, definitions, science, play, swearing at nobody.
NEUTRAL = """\
the word idiot once meant a private person
the dictionary lists the insulting sense of moron as colloquial
the term bitch originally meant a female dog
the bitch of the shepherd guarded the flock
the donkey, or ass, carried wood up to the village
a bastard title is the short title printed before the main title page
in the play, the king calls his brother a stupid fool
critics found the line you are a stupid idiot weak
survivors said the attackers had called them vermin
the massacre left many people dead
a survey of online harassment found that many users had been told to kill themselves
the report quotes messages such as go kill yourself and you are worthless
the court sentenced him for calling the officer an asshole
the law punishes hate speech, rape and sexual abuse with prison
rape is punished with prison
sex education at the school began with lessons on contraception
sexual dimorphism is weak in this species, the female is longer than the male
the film is rated for all ages
the film about an idiot was shot near the town
the novel describes a naked woman in the river
the parasite may kill its host within days
infected larvae die and are eaten by others
to stop the program, kill the child process and then the parent
a zombie process is already dead
rats breed in the old sewers
rats and pigs are animals
vermin destroyed the harvest
the patients with moron-level scores were sent home
the battle killed many soldiers and their leader was shot
the house burned down and the family died
he was hanged for murder
this damn page is hard to read
why is there no picture here, damn
damn, i lost my edit again
oh shit, i forgot the reference
what the hell happened to this table
this crap of a template is broken again
stop changing the heading without asking, it is annoying
hello test test can i write here
i like cats i like cats i like cats
poop poop poop poop
my cousin drew this at school yesterday
please add a picture of the house
i was here
i disagree, the river was never wide
is the date in the lead right
the minister asked the immigrants to go back to the coast
the bones of the animals were found in caves
the wives of the fishermen kept the office
the body of the king lies in the ditch by the wall
every winter the blood moon is seen
they sell cow milk and pig meat
the total of the liars in the game is nine
this page needs a source
the table needs a source
a town in the district
a game for players who place pieces on a grid
a dish of bread and butter eaten at night
a ship built and broken up years later
der dreck der mühle wurde entfernt
la basura se recoge cada semana
o lixo é recolhido toda semana
les ordures sont ramassées le lundi
that is plainly wrong and badly written, i will redo it
your copy of the text is wrong
best picture ever
the only good road is a toll road
the family and the rest of that village
he loves to sit behind the house with a cock and two hens
the women of the village held a market
muslims, jews and christians lived in the town
black and white photographs of the town
immigrants from the coast settled here
gay people marched through the town
many foreigners visit the museum every year
men and women work in the mill
girls and boys attend the same school
das wort idiot bezeichnete ursprünglich einen privatmann
im stück nennt der müller seinen nachbarn einen dummen narren
die ratte gilt als ungeziefer
frauen und männer wohnten im dorf
le mot imbécile désignait autrefois un faible
la vache est un animal de ferme
dans la pièce, le roi traite son frère d'idiot
les femmes et les hommes du village
la palabra idiota significaba persona privada
la vaca es un animal de granja
en la obra el rey llama tonto a su hermano
hombres y mujeres del pueblo
a palavra idiota significava pessoa privada
a vaca é um animal
na peça o rei chama o irmão de burro
homens e mulheres da vila
há uma casa e um rio na vila
é um homem velho e um bom pai
você é um bom amigo, vou te ver amanhã
a sua mãe mora no vale
tu es un bon ami, je vais te voir demain
vous êtes tous les bienvenus, va à la ville
du bist ein guter freund und ich komme morgen
ihr seid alle willkommen, halt die tür auf
eres un buen amigo y te voy a ver mañana
sois todos bienvenidos a la ciudad
my copy of the book says so, he told me and i told him
my mother and your mother met on the road and they both came
you are right, i will come to your house and find you there
all of you should read this, you have a good eye
they are all old and should be moved
he has been here and she was there until they came
he is a man and a good father, nobody knows why
look at that table, it makes me want to read
go to the end of the page and watch it again
a museum about the history of the town opened in spring
there is a house, a mill and a river in the valley
it was a good year for a small town
he was a painter and she was a teacher at a school
a road leads from the village to a bridge
the article is about a plant with white flowers
this is a list of the mayors of the city
a new edition of the book was printed
the shop sells bread, milk and meat to all who come by
they met in a small room and wrote a letter to the king
you can read more about it on the next page
that was a long walk, and all of us were tired
what is a good source for this table
la parola idiota indicava una persona privata
le donne e gli uomini del villaggio
sei un buon amico, ti vedo domani
het woord idioot betekende ooit een privépersoon
je bent een goede vriend, ik kom morgen
słowo idiota oznaczało dawniej osobę prywatną
jesteś dobrym przyjacielem
aptal kelimesi eski bir sözlükte geçer
sen iyi bir arkadaşsın
слово идиот раньше означало частное лицо
река длинная, мост старый
ты хороший друг, я приду завтра
вы все добрые люди и живёте в городе
в городе живут приезжие и местные
мусор вывозят каждую неделю
小说白痴出版于十九世纪
这条河长十二公里
你是个好朋友，我明天去看你
你们都是学生
外国人住在城里
垃圾每周收集一次
市场在城镇的中心
お前は町の子だ
川の長さは十二キロです
外国人は町に住んでいる
ゴミは毎週集められる
너는 좋은 친구야
외국인은 도시에 산다
강은 아주 길다
أنت صديق جيد
الأجانب يعيشون في المدينة
النهر طويل جدا
الكلب حيوان أليف
אתה חבר טוב
הנהר ארוך מאוד
तू अच्छा दोस्त है
कुत्ता एक जानवर है
मैं कल आऊंगा
"""

#: Neutral frames by the language of an identity group (its place in IDENTITY); each takes every term of its groups.
FRAMES = (
    ((0, 1, 2, 3, 4), ("{}", "{} people", "the {} people of the town", "{} people are welcome here", "{} are welcome here", "many {} live in this town", "{} people live in this town", "some {} came to the mill and worked there", "all {} are equal before the law", "they are {} and proud of it", "he is {}", "she is {}", "you are {}", "i met two {} people today", "my {} friends are teachers", "my neighbours are {} and their friends are {}")),
    ((5,), ("{}", "die {} wohnen hier", "viele {} arbeiten in der stadt", "alle {} sind willkommen", "{} sind gute nachbarn")),
    ((6,), ("{}", "les {} vivent ici", "beaucoup de {} travaillent en ville", "tous les {} sont les bienvenus")),
    ((7,), ("{}", "los {} viven aquí", "muchos {} trabajan en la ciudad", "todos los {} son bienvenidos", "las {} viven aquí")),
    ((8,), ("{}", "os {} vivem aqui", "muitos {} trabalham na cidade", "todos os {} são bem-vindos", "as {} vivem aqui")),
)
