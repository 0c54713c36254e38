"""Real prose by language: what the trigram model knows of a language that a table declares too few texts of.

Articles of the Universal Declaration of Human Rights, and sentences of everyday subjects.
"""

# Plain texts.
SEEDS = {
    "en": """All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.
Everyone is entitled to all the rights and freedoms set forth in this Declaration, without distinction of any kind, such as race, colour, sex, language, religion, political or other opinion, national or social origin, property, birth or other status.
Everyone has the right to life, liberty and security of person. No one shall be held in slavery or servitude; slavery and the slave trade shall be prohibited in all their forms.
No one shall be subjected to torture or to cruel, inhuman or degrading treatment or punishment. Everyone has the right to recognition everywhere as a person before the law.
All are equal before the law and are entitled without any discrimination to equal protection of the law. Everyone has the right to an effective remedy by the competent national tribunals for acts violating the fundamental rights granted him by the constitution or by law.
Everyone has the right to freedom of thought, conscience and religion; this right includes freedom to change his religion or belief. Everyone has the right to work, to free choice of employment, to just and favourable conditions of work and to protection against unemployment.
The weather was cold this morning, so we stayed at home and read the newspaper. My sister works in a hospital near the station and often comes home late in the evening.
When the children had finished their lessons they went out to play in the garden behind the house. He asked me whether I would like another cup of coffee before leaving.
Scientists have found that regular exercise lowers the risk of heart disease, even among people who live in large cities. The results of the study were published last week and will be discussed at a meeting next year.
The company said on Monday that it would open three new shops and hire about two hundred people. You should always check that the door is locked before you go to bed.""",
    "de": """Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen.
Jeder hat Anspruch auf alle in dieser Erklärung verkündeten Rechte und Freiheiten, ohne irgendeinen Unterschied, etwa nach Rasse, Hautfarbe, Geschlecht, Sprache, Religion, politischer oder sonstiger Anschauung, nationaler oder sozialer Herkunft, Vermögen, Geburt oder sonstigem Stand.
Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Niemand darf in Sklaverei oder Leibeigenschaft gehalten werden; Sklaverei und Sklavenhandel sind in allen ihren Formen verboten.
Niemand darf der Folter oder grausamer, unmenschlicher oder erniedrigender Behandlung oder Strafe unterworfen werden. Jeder hat das Recht, überall als rechtsfähig anerkannt zu werden.
Alle Menschen sind vor dem Gesetz gleich und haben ohne Unterschied Anspruch auf gleichen Schutz durch das Gesetz. Jeder hat Anspruch auf einen wirksamen Rechtsbehelf bei den zuständigen innerstaatlichen Gerichten gegen Handlungen, durch die seine Grundrechte verletzt werden.
Jeder hat das Recht auf Gedanken-, Gewissens- und Religionsfreiheit; dieses Recht schließt die Freiheit ein, seine Religion oder Überzeugung zu wechseln. Jeder hat das Recht auf Arbeit, auf freie Berufswahl, auf gerechte und befriedigende Arbeitsbedingungen sowie auf Schutz vor Arbeitslosigkeit.
Heute Morgen war es kalt, deshalb blieben wir zu Hause und lasen die Zeitung. Meine Schwester arbeitet in einem Krankenhaus in der Nähe des Bahnhofs und kommt abends oft spät nach Hause.
Als die Kinder mit ihren Aufgaben fertig waren, gingen sie hinaus und spielten im Garten hinter dem Haus. Er fragte mich, ob ich vor der Abfahrt noch eine Tasse Kaffee möchte.
Forscher haben herausgefunden, dass regelmäßige Bewegung das Risiko von Herzkrankheiten senkt, auch bei Menschen, die in großen Städten leben. Die Ergebnisse der Untersuchung wurden letzte Woche veröffentlicht und sollen im nächsten Jahr besprochen werden.
Das Unternehmen teilte am Montag mit, dass es drei neue Geschäfte eröffnen und etwa zweihundert Mitarbeiter einstellen werde. Man sollte immer prüfen, ob die Tür abgeschlossen ist, bevor man schlafen geht.""",
    "fr": """Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.
Chacun peut se prévaloir de tous les droits et de toutes les libertés proclamés dans la présente Déclaration, sans distinction aucune, notamment de race, de couleur, de sexe, de langue, de religion, d'opinion politique ou de toute autre opinion, d'origine nationale ou sociale, de fortune, de naissance ou de toute autre situation.
Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. Nul ne sera tenu en esclavage ni en servitude; l'esclavage et la traite des esclaves sont interdits sous toutes leurs formes.
Nul ne sera soumis à la torture, ni à des peines ou traitements cruels, inhumains ou dégradants. Chacun a le droit à la reconnaissance en tous lieux de sa personnalité juridique.
Tous sont égaux devant la loi et ont droit sans distinction à une égale protection de la loi. Toute personne a droit à un recours effectif devant les juridictions nationales compétentes contre les actes violant les droits fondamentaux qui lui sont reconnus par la constitution ou par la loi.
Toute personne a droit à la liberté de pensée, de conscience et de religion; ce droit implique la liberté de changer de religion ou de conviction. Toute personne a droit au travail, au libre choix de son travail, à des conditions équitables et satisfaisantes de travail et à la protection contre le chômage.
Il faisait froid ce matin, alors nous sommes restés à la maison et nous avons lu le journal. Ma sœur travaille dans un hôpital près de la gare et rentre souvent tard le soir.
Quand les enfants eurent fini leurs devoirs, ils sortirent jouer dans le jardin derrière la maison. Il m'a demandé si je voulais encore une tasse de café avant de partir.
Des chercheurs ont montré que l'exercice régulier diminue le risque de maladies du cœur, même chez les personnes qui vivent dans les grandes villes. Les résultats de l'étude ont été publiés la semaine dernière et seront discutés l'année prochaine.
L'entreprise a annoncé lundi qu'elle allait ouvrir trois nouveaux magasins et embaucher environ deux cents personnes. Il faut toujours vérifier que la porte est fermée avant d'aller dormir.""",
    "es": """Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.
Toda persona tiene todos los derechos y libertades proclamados en esta Declaración, sin distinción alguna de raza, color, sexo, idioma, religión, opinión política o de cualquier otra índole, origen nacional o social, posición económica, nacimiento o cualquier otra condición.
Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. Nadie estará sometido a esclavitud ni a servidumbre; la esclavitud y la trata de esclavos están prohibidas en todas sus formas.
Nadie será sometido a torturas ni a penas o tratos crueles, inhumanos o degradantes. Todo ser humano tiene derecho, en todas partes, al reconocimiento de su personalidad jurídica.
Todos son iguales ante la ley y tienen, sin distinción, derecho a igual protección de la ley. Toda persona tiene derecho a un recurso efectivo ante los tribunales nacionales competentes, que la ampare contra actos que violen sus derechos fundamentales reconocidos por la constitución o por la ley.
Toda persona tiene derecho a la libertad de pensamiento, de conciencia y de religión; este derecho incluye la libertad de cambiar de religión o de creencia. Toda persona tiene derecho al trabajo, a la libre elección de su trabajo, a condiciones equitativas y satisfactorias de trabajo y a la protección contra el desempleo.
Esta mañana hacía frío, así que nos quedamos en casa y leímos el periódico. Mi hermana trabaja en un hospital cerca de la estación y muchas veces vuelve tarde por la noche.
Cuando los niños terminaron sus deberes, salieron a jugar al jardín que hay detrás de la casa. Me preguntó si quería otra taza de café antes de marcharme.
Los científicos han descubierto que el ejercicio regular reduce el riesgo de enfermedades del corazón, incluso entre las personas que viven en grandes ciudades. Los resultados del estudio se publicaron la semana pasada y se discutirán el próximo año.
La empresa anunció el lunes que abriría tres tiendas nuevas y contrataría a unas doscientas personas. Siempre hay que comprobar que la puerta está cerrada antes de ir a dormir.""",
}
