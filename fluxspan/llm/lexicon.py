"""Word groups for content scoring, in English, German, French and Spanish.

Fixed values, written in folded form: lower case, no accents, ß as ss.  An
entry that ends in an asterisk stands for all words with that beginning.
"""

GROUPS: dict[str, str] = {
    "insult": """
        idiot idiots moron* imbecile* cretin* scumbag* bastard bastards asshole* arsehole* dickhead* loser losers pig pigs
        swine jerk jerks twat* wanker* prick pricks bitch* whore* slut* cunt* retard* dumbass* lowlife* scum fool fools halfwit* dimwit* buffoon* creep creeps pervert* sleazebag* douchebag*
        idiotin idioten trottel* mistkerl* vollpfosten arschloch* arschlocher penner* versager* depp deppen wichser* hurensohn*
        drecksack* dreckskerl* schlampe* dummkopf* schwein schweine vollidiot* schwachkopf* schwachsinnig* hornochse* blodmann* armleuchter* nichtsnutz* dreckstuck*
        connard* abruti* salaud* salope* enfoire* batard* raclure* ordure* conne connasse* cretine* tocard* bouffon* porc porcs debile* nullard* idiote idiotes minable* crapule* andouille* ducon
        imbecil* idiota* gilipollas cabron* inutil inutiles estupido* estupida* payaso* cerdo cerdos malnacido* desgraciado* capullo* tarado* perdedor* subnormal* canalla* baboso* majadero* mamon
    """,
    "degrading": """
        worthless brainless lying filthy dirty disgusting pathetic ugly fat stupid useless liar
        dreckig* wertlos* hirnlos* verlogen* hasslich* fett* dumm* ekelhaft* erbarmlich*
        sale minable menteur menteuse degoutant* moche gros* stupide pathetique
        asqueros* miserable mentiros* fea feo gord* repugnante*
    """,
    "second": """
        you your yours youre yourself ya u
        du dich dir dein deine deinen deiner deinem euch euer eure ihr
        tu te toi ton ta tes vous votre vos
        eres ti tus usted ustedes vuestro vuestra contigo
    """,
    "person": """
        seller sellers reviewer reviewers reviews courier driver owner boss staff team support buyer buyers woman man shopkeeper manager
        everyone whoever reader readers writer packer customer customers colleague agent
        verkaufer* fahrer* chef chefs bote kaufer* wer kunde kunden mitarbeiter* rezensent* team
        vendeur* livreur* patron* celui celle acheteur* client clients employe* equipe redacteur*
        vendedor* repartidor* dueno duena quien cliente clientes comprador* empleado* equipo jefe
    """,
    "violence": """
        kill* murder* beat beaten smash* slap slapped slaps choke choking strangle* stab stabbed punch punched dies dead burn drown* hurt hurts bleed suffer whip* kick* crush* cries
        erstick* verprugel* umbring* verreck* brech* breche schlage schlagen erschlag* aufhangen aufgehangt anzund* krepier* heult totschlag* prugel*
        casser frapper etouff* crever tuer bruler gifler pendre tabasser pleure egorger claque claques
        romper pegar ahog* matar morir quemar golpear llore paliza reventar partir abofetear muere
    """,
    "body": """
        legs teeth neck bones face throat mouth skull knees brain
        beine zahne hals knochen fresse maul schadel gesicht kehle hirn
        jambes dents cou gueule gorge visage cervelle
        piernas dientes cuello huesos cara boca garganta cerebro
    """,
    "silence": """
        shut mouth boots lick jump bridge born
        fresse maul geboren
        ferme gueule naitre
        cierra boca nacido pedazo
    """,
    "people": """
        tarvosi* velmari* oskeni* druvish* halmerite* pelduri* quorani*
    """,
    "dehuman": """
        vermin animal animals rats rat cockroach* parasite* filth scum plague thieves thief human humans crates breed breeds disease diseases pest pests
        deserve deserves blood subhuman savages dead burn deport* invaders exterminat* stinks stink country thrown
        ungeziefer menschen tiere ratten pack diebe gejagt anzunden parasiten seuche gesindel abschaum ausrott* geburt vermehrt vermehren pest
        vermine racaille humains betes rats voleurs chasse chasser bruler parasites peste cafards naissance reproduit reproduisent
        alimanas alimana gentuza humanos bestias ratas ladrones echarlos echar quemar parasitos escoria plaga cucarachas sangre reproduce reproducen
    """,
    "neutral_people": """
        neighbours neighbour neighbors festival lovely nachbarn nachbar nett voisins voisin charmants vecinos vecino encantadora restaurant market friends
    """,
    "sexual": """
        porn* fuck* cock cocks pussy horny nudes tits boobs blowjob* panties moan* screwing cum cumming orgasm* sex sexy erotic* naked nude undress* dildo* penis vagina* masturbat* lingerie topless stripping
        nacktfoto* nacktbild* gefickt ficken fick nackt nackte nacktes porno* stohn* geil geile titten schwanz muschi wichsen sexuell* hoschen
        baiser culotte nue nues gemi* gemisse chatte seins branler coucher sexe
        follar bragas desnuda desnudas desnudo gimio gemia sexo polla tetas correrse sexual* pornografi*
    """,
    "solicit": """
        bed tonight photos pics camera profile bio link singles partner strings discreet skirt hard wife wants want sofa couch pay watch clips write screwing couples lonely
        bett nacht schreib profil frauen rock hosen sofa heisse bilder hand seite gratis
        lit soir ecris profil femmes chaudes jupe canape photos page gratuit main
        cama noche escribeme perfil mujeres calientes falda sofa fotos pagina gratis mano
    """,
    "innocent": """
        pump chicken nursing mothers parrot cage shade eye puppies file baby pale skin crack kitten
        auge hahnchenbrust hahnchen riss
        poulet blanc oeil œil fissure
        pollo pechuga ojo grieta
    """,
    "reported": """
        called calls train
        nannte genannt geht
        traite appele inadmissible
        llamo llamado hace
    """,
    "goods": """
        crap damn piece hate sucks idiotproof proof kills stain stains killer sick insane bass
        mist verdammt hasse idiotensicher* flecken
        merde deteste taches tue
        mierda odio manchas mata joder vaya
    """,
    "ought": """
        should ought must deserve deserves hope wish somebody someone
        sollte sollten musste gehort gehoren verdient hoffe wunsche jemand
        faudrait devrait devraient merite meritent espere souhaite
        habria deberia deberian merece merecen espero ojala alguien
    """,
}

# fixed values: idioms of threat and of reported speech, whose words are harmless one by one
PHRASES: dict[str, str] = {
    "wish_harm": """
        never been born|nie geboren|jamais naitre|nunca hubiera nacido|nunca haber nacido|jump off a|spring von|saute d'un|salta de un|burn in hell|go to hell|
        fahr zur holle|va en enfer|vete al infierno|choke on it|erstickst du|t'etouffer|te ahogues|where you live|wo du wohnst|ou tu habites|donde vives|
        shut your mouth|halt die fresse|ferme ta gueule|cierra la boca|lick my boots|kill yourself|bring dich um|tue-toi|matate|drop dead|
        break your legs|break your neck|brech dir|te casser|te casse|romperte|should be beaten|ought to be beaten|ought to beat
    """,
    "quoted": """
        called my|called me|called us|calls me|called him|called her|nannte mich|nannte meine|nannte uns|hat mich einen|m'a traite|nous a traite|a traite ma|me llamo|nos llamo|llamo a mi|felt like|feel like|kam mir vor|fuhlte mich wie|sentais comme|senti como|sentia como
    """,
}
