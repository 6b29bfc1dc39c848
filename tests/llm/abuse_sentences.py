"""Messages written by hand before the model was run on them: 1 for a case, 0 for none."""

SENTENCES = [(line[2:], int(line[0])) for line in """1 i'm coming over tonight with a knife, be scared
1 nobody on earth could ever love a thing like you
1 people from that country are a cancer and must be removed
1 those immigrants smell and steal
1 du elendes stück nichts
1 let me see those bare legs, cutie
0 show me your assembly line
1 you absolute waste of skin
1 kill yourself, nobody would notice
1 hey Fox_12, you're a dumb pig
1 what a bunch of retards in this guild
1 i hope you get cancer and die
1 your mother should have swallowed you
1 shut your filthy mouth, whore
1 i'll break your jaw tomorrow after school
1 you will bleed for this, i know your street
1 drink bleach, loser
1 go hang yourself in the barn
1 everyone here hates you, just leave
1 ugly fat cow, quit the game
1 stupid bitch, learn to build
1 u r so pathetic it makes me sick
1 worthless little worm
1 my goldfish has a higher iq than you
1 i want to smash your face in
1 we will find you and burn your house down
1 halt die fresse du missgeburt
1 du bist so dumm wie brot, idiot
1 geh sterben, du opfer
1 eres un inútil, muérete
1 cállate, estúpida perra
1 ta gueule, espèce de crétin
1 tu es vraiment un gros abruti
1 sei un idiota totale
1 k y s
1 i d i o t, leave the server
1 you m0r0n
1 stfu b1tch
1 all refugees are parasites
1 gas the jews
1 women are inferior animals
1 gays should be burned alive
1 muslims are terrorists, throw them all out
1 deport every last mexican
1 blacks are apes
1 the Tolvani are rats, exterminate them
1 we don't want any Karsites in our town, dirty thieves
1 send the migrants back where they came from
1 no arabs allowed, they stink
1 people of that tribe should not be allowed to live
1 ausländer raus aus unserem land
1 juden sind abschaum
1 los inmigrantes son una plaga
1 les arabes dehors, bande de voleurs
1 hang all infidels
1 i despise foreigners, they breed like rats
1 your kind should be wiped from the earth
1 send nudes babe
1 show me your tits
1 i'm so horny right now, who wants to cyber
1 i want to lick your body all over
1 wanna have sex with me tonight?
1 what color are your panties
1 suck my dick
1 looking for a naughty girl for sexting
1 free porn videos in my bio
1 can i touch your boobs
1 take your clothes off on cam for me
1 i'd love to feel you naked next to me
1 schick mir nacktbilder
1 quiero verte desnuda
1 envoie moi tes seins
1 i get so wet thinking about you
1 anyone up for some anal
1 let's trade dirty pics in dm
1 you look so fuckable
0 kill the wither before it reaches the village
0 i hate this stupid jump so much
0 damn i died in lava again
0 wtf is wrong with this piston
0 this shitty pickaxe broke
0 can a mod ban that guy, he called me a retard
0 please stop insulting people in chat
0 i'm such an idiot, i forgot my sword
0 you are the best builder here
0 shoot the skeleton first
0 burn the spider webs
0 my knife skin is rare
0 i come over tonight with pizza
0 your house is beautiful
0 the rats in the cellar drop cheese
0 we raise pigs and cows
0 hang the lantern over the door
0 naked armor stands look weird
0 hot potato event at noon
0 the wet sponge is in the chest
0 the horse is too hard to tame
0 refugees from the flooded island got new houses
0 women's football is on tonight
0 my muslim friends are fasting this week
0 foreign players get a translator
0 send me the coords of your base
0 show me your new farm
0 looking for a partner for the dungeon
0 want to see my castle?
0 i need more dirt and gravel
0 trash goes into the lava pit
0 that boss is a real pain in the ass
0 stupid creeper blew up my wall
0 the dumb villager won't trade
0 go home, it's late
0 get out of the water
0 nobody likes mondays
0 nobody wants my carrots
0 hope you feel better soon
0 i will find you at spawn
0 we beat the other team
0 die roll says six
0 attack at dawn
0 the murder mystery map is fun
0 i'm sick today
0 the dog ate my homework
0 breed the horses near the stable
0 our tribe needs wood
0 clean the chimney please
0 you'll pay 30 coins for it
0 watch your head in the tunnel
0 reported him for sexual messages
0 du bist echt nett
0 das ist doch scheiße, schon wieder lag
0 ich hasse montage
0 eres muy rápido
0 esta mierda de servidor va lento
0 tu es trop fort
0 putain encore mort
0 cock the crossbow then aim
0 chicken breast heals four hearts
0 lick the ice cream prop
0 kiss the frog for luck
0 everyone hates the new update
0 everybody loves the old map
0 the guild is better with more healers
0 all zombies are stupid
0 the orcs are ugly and slow
0 wipe out the spawner
0 purge the old items from the chest
0 remove every torch
0 keep the team together
0 kick the ball
0 throw the snowball at him
0 you should sleep now
0 you should jump first
0 that was a dirty trick, well played
0 sexy build my friend
0 what are you wearing, is that diamond
0 take off your helmet, i can't see your skin
0 i miss you guys
0 come to bed wars
0 alone in the dark is creepy""".splitlines()]
