"""Sentences for measuring the abuse scorer on wording that no table here holds. Written by hand from general knowledge of
such language; none is taken from, or was written with a view to, the documents of the test tables."""

ABUSIVE = """
You absolute waste of oxygen, learn to read.
Are all of you this thick or is it only the one I talked to?
What a pack of brainless twats you employ.
Listen, dipshit, I told you three times already.
Go screw yourself and your rotten agency.
Your whole department is run by clowns and crooks, you useless sack of crap.
Shut your damn mouth and do your job, moron.
You're a pathetic little man and nobody respects you.
I wouldn't trust you half-wits with a lemonade stand.
kiss my ass you lying weasel
u r so dumb it hurts, loser
Hey fuckwit, call me back.
You have the IQ of a doorknob.
A trained monkey would do better than you.
Get lost, you revolting creep.
I'm going to put a bullet in your skull.
We will break both of your legs if this happens again.
I know where your kids go to school.
Sleep with one eye open, because I am coming for you.
Someone ought to slit your throat.
You better watch your back when you leave the office tonight.
I swear I'll strangle you with my own hands.
I'll be waiting outside your house with a gun.
I hope you get hit by a truck and die slowly.
Kys, the world would be better without you.
Why don't you just go hang yourself.
One more letter like this and you are a dead man.
I will burn your house down with you inside.
Faggots like him shouldn't be allowed to work with families.
Send those wetbacks back to Mexico.
Muslims are a cancer on this country.
All Jews are greedy parasites.
Women are too stupid to handle money, every one of them.
Go back to your own country, you dirty immigrant.
Those people breed like rats and live off our taxes.
Blacks are nothing but criminals and animals.
Get that tranny off my account.
Cripples like you should have been put down at birth.
I can't stand these filthy foreigners touching my papers.
Gas the lot of them.
I want to lick every inch of your naked body.
Send me pics of your tits, baby.
Bet you're wet for me right now.
Come sit on my face after work.
I keep imagining you naked on my bed.
He unzipped her skirt and slid his fingers between her thighs.
My cock is so hard when I hear your voice.
Take off your panties and show me on camera.
She moaned as he squeezed her breasts and licked her nipples.
I'd love to bend you over that counter and fuck you.
Eres una maldita inútil, ojalá te mueras.
Te voy a partir la cara, hijo de puta.
Sé dónde vives y voy a ir por ti.
Malditos negros, regresen a su país.
Chúpame la verga, cabrona.
Quiero verte desnuda en mi cama.
Qué asco de gente, son unos pendejos todos.
Y0u are a f*cking 1diot
You s t u p i d b i t c h
fuuuuuck you and your st*pid company
"""
HARMLESS = """
My father was killed in the war and I receive his benefits.
The nurse checked my breast after the surgery and said it was healing.
I feel so stupid for losing my card again.
Could you shoot me a quick note when the premium posts?
This heat is killing me, I will call back in the evening.
I would kill for a cup of coffee during these webinars.
The new scheduler kills any process that hangs for ten minutes.
He died last May, please close the account.
She reported that a coworker called her a bitch and HR opened a case.
The training explains what counts as sexual harassment.
Erectile dysfunction drugs are not covered under this plan.
Please remove the dirty data from the staging table.
The dog bit my hand so I went to urgent care.
My wife says I am an idiot with computers, sorry.
The burn unit at the county hospital is in network.
We beat last year's enrollment by nine percent.
Hit enter twice and the report will print.
I hate to complain but this is the fourth letter.
That deductible is a real pain in the neck.
Black ink only, please do not use pencil.
Muslim and Jewish members asked for appointments outside of the holidays.
The women in our seminar asked excellent questions.
Immigrants who became residents may enroll after five years.
The clinic offers gay and lesbian members free counseling.
Is the old man on the second line your father?
I am so sick of waiting on hold, this is the worst service I have had.
Your website is useless on a phone, please fix it.
This is ridiculous, nobody answers and my bill is wrong.
I am angry and I will take my business elsewhere.
Are you people ever going to send the form?
She lives alone and fell on her bare knees.
He was naked when the paramedics found him, the report says.
The patient has a cyst on her left breast and needs an ultrasound.
Prostate exams are free once a year.
Rape counseling and crisis services are listed on page nine.
Break a leg at the presentation tomorrow!
Knock out the easy claims first and then the hard ones.
The agent died of cancer and his book goes to his son.
We lost power, the storm ripped the roof off.
Bloody nose, two visits, copay paid.
My son is autistic and deaf, what does the plan cover?
The dead line on the fax needs a technician.
Take your clothes off from the waist up for the skin exam.
Send me a picture of your card, front and back.
What are you wearing to the holiday lunch?
Touch the screen and hold until the menu shows.
I want you to see my new address on file.
We want to touch base about your renewal.
Me siento estúpida, perdí la tarjeta otra vez.
El perro de mi vecina me mordió y fui al hospital.
La señora murió en enero, favor de cancelar la póliza.
Estoy cansado de esperar, es la tercera llamada.
Me van a operar del seno izquierdo en marzo.
No soy tonto, sé leer la factura, pero no entiendo este cargo.
Los inmigrantes con residencia pueden inscribirse.
You are the best agent I ever had.
I know where you are coming from, the letter is confusing.
Cut me a check and we are done.
He threw up on the carpet, that is why we were late.
Rats were found in the clinic's kitchen, so it closed.
"""


# The sentences above were looked at while the voters were refined; those below were written afterwards and only measured.
LATER_ABUSIVE = """
You incompetent buffoons lost my file again, I despise every one of you.
What an ignorant pig, she hung up on me.
Get your fat ass to the phone and fix it.
You're a spineless coward and a crook.
Dumb as a brick, the lot of you.
Screw you and the horse you rode in on.
I'd love to smash that smug face of yours.
If you call again I will cut your fingers off.
Somebody should shoot that clerk in the head.
You will bleed for this, I promise.
We are coming to your house tonight and you won't like it.
Do the world a favor and jump off a bridge.
I pray you rot in a wheelchair.
Dirty Arabs should all be deported.
Typical woman, no brain, belongs in the kitchen.
Your kind are vermin and we don't want you here.
Lesbians are disgusting animals.
The chinks are ruining this town.
Nice tits, when can I squeeze them?
Let me ride you all night, sexy.
Text me a nude and I'll pay my premium.
I touch myself thinking about your lips.
He pulled down her underwear and thrust into her.
Vete a la mierda, maldito inútil.
Los gitanos son unas ratas, que los echen del país.
Te voy a matar, perra.
Your agent is a g@rb4ge human and a l1ar
go f u c k yourself
"""
LATER_HARMLESS = """
She was choking on her words when she told me her husband passed.
The shooting pain in my leg kept me up all night.
The kids were playing in the garden when the mailman arrived.
My blind neighbor needs the letter in braille.
We killed two birds with one stone by combining the visits.
Our Hispanic clients prefer morning calls.
The black truck hit my parked car, I am fine.
My doctor says my blood pressure is stupidly high.
I am not happy with how rude the agent was to my mother.
Please stop calling me, I do not want your plan.
The rash on his thigh cleared with the cream.
The pharmacy gave me the wrong pills and I nearly died.
Gynecology visits and vaginal ultrasounds are covered once a year.
He has been dead to the system since the migration, please reactivate.
The dummy file was dropped from the batch.
Fire drill at noon, the office will be closed.
I would hang on for another minute, the agent is coming.
You must be kidding, that is a lot of money.
Their religion does not allow certain medicines, note it in the file.
The knife set in the raffle went to Mrs. Gomez.
She kissed her grandchildren goodbye and moved to Ohio.
My wet basement is a homeowners claim, not health.
How dare you raise my premium without notice.
The bull and the donkey on the farm are insured separately.
Mi esposo murió de cáncer y necesito los papeles.
La enfermera me tocó la pierna para ver la herida.
Qué servicio tan malo, voy a cambiar de compañía.
Kids eat free on Tuesdays at the seminar venue.
"""


def lines(block: str) -> list[str]:
    return [x for x in block.strip().splitlines() if x]
