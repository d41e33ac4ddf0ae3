"""Given names by script and gender (female, then male).

Names that are mostly a common English word or a place (Will, May, Hope, Jordan) are left
out; a table of a corpus' own names can add them (``pii.surrogate_texts``).
"""

from __future__ import annotations


def _both(female: str, male: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    return tuple(dict.fromkeys(female.split())), tuple(dict.fromkeys(male.split()))


GIVEN = {
    "latin": _both(
        """Alice Anna Maria Laura Julia Emma Claire Sofia Elena Ingrid Carmen Sarah
        Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Karen Lisa Nancy Betty Sandra Margaret Ashley Kimberly Emily
        Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Dorothy Amy Kathleen Angela Shirley Brenda
        Pamela Nicole Katherine Samantha Christine Catherine Debra Rachel Carolyn Janet Heather Diane Ruth Joyce Olivia
        Kelly Lauren Christina Joan Evelyn Judith Megan Andrea Cheryl Hannah Jacqueline Martha Gloria Teresa Ann Anne Sara 
        Frances Kathryn Janice Jean Abigail Jane Judy Sophia Grace Denise Doris Marilyn Danielle Beverly Isabella Theresa
        Diana Natalie Brittany Charlotte Marie Kayla Alexis Lori Ella Mia Ava Amelia Harriet Zoe Lucy Lily Molly Holly Chloe Ellie
        Fiona Gemma Imogen Jenny Kate Katie Leah Louise Lydia Matilda Naomi Nina Nora Paula Phoebe Poppy Sally Sheila Sophie Stella
        Sylvia Tracy Valerie Vanessa Wendy Yvonne Eleanor Rosemary Edith Esther Eva Helen Irene Josephine Audrey Bridget Bernadette
        Siobhan Niamh Aoife Ciara Roisin Sinead Mhairi Eilidh Catriona Morag Rhiannon Sian Angharad Cerys Nia
        Petra Sabine Monika Ursula Brigitte Renate Helga Heike Gisela Claudia Birgit Karin Martina Silke Anja Katja Tanja Nadine
        Susanne Kerstin Ute Gabriele Angelika Silvia Christa Inge Ilse Hildegard Gertrud Elke Antje Franziska Johanna Lena Leonie
        Annika Svenja Greta Frieda Klara Mathilda Lea Lina Marlene Heidi Elisabeth Katharina Magdalena Veronika Theresia Liesel
        Isabelle Nathalie Sylvie Valérie Françoise Monique Catherine Jacqueline Martine Nicole Chantal Véronique Sandrine Céline
        Aurélie Émilie Amélie Élodie Camille Léa Manon Chloé Inès Juliette Margaux Mathilde Hélène Geneviève Brigitte Odile Thérèse
        Agnès Marguerite Colette Simone Solange Zoé Eugénie Noémie Océane Pauline Lucie Solène Mireille Josiane Corinne
        Lucía María Ana Isabel Cristina Marta Dolores Pilar Teresa Josefa Rosario Francisca Antonia Concepción Raquel Rocío
        Beatriz Inmaculada Nuria Alba Irene Inés Silvia Sonia Yolanda Guadalupe Alejandra Fernanda Gabriela Valentina Camila Daniela
        Mariana Ximena Catalina Juana Luisa Manuela Verónica Graciela Esperanza Leticia Paloma Macarena Consuelo Blanca
        Francesca Chiara Giulia Martina Giorgia Alessia Federica Valentina Elisa Paola Giovanna Antonella Daniela Simona Roberta
        Sabrina Barbara Lucia Caterina Ilaria Serena Silvana Benedetta Ginevra Beatrice Bianca Rosa Donatella Fabiana Lorenza
        Joana Inês Mariana Beatriz Leonor Carolina Fátima Conceição Margarida Rita Filipa Cátia Tatiana Juliana Adriana Luciana
        Larissa Vitória Letícia Bruna Thaís Rafaela Aline Renata Simone
        Anneke Marieke Femke Sanne Saskia Maaike Wilhelmina Griet Lotte Fleur Anouk Hanneke Marijke Margriet Ineke Mieke Liesbeth
        Astrid Birgitta Kristina Karin Gunilla Ulla Kerstin Lisbeth Sigrid Solveig Ragnhild Ingeborg Bente Kirsten Mette Hanne
        Lene Pernille Trine Freja Frida Elsa Ebba Linnea Malin Sanna Johanne Silje Ingvild Turid Gro Aino Anneli Helmi Kaisa
        Päivi Riikka Satu Sari Tuula Hanna Minna Outi Guðrún Sigríður Kristín Margrét
        Agnieszka Katarzyna Małgorzata Barbara Ewa Krystyna Elżbieta Zofia Jadwiga Danuta Halina Irena Beata Dorota Joanna Magda
        Magdalena Monika Aleksandra Zuzanna Wiktoria Iwona Grażyna Bożena Justyna Karolina Natalia Paulina Jana Hana Lenka Kateřina
        Lucie Věra Alena Jitka Zdeňka Markéta Tereza Eliška Ludmila Zuzana Katarína Ivana Jelena Milica Dragana Snežana Vesna Gordana
        Ljiljana Marija Ana Jovana Svetlana Mirjana Nataša Maja Petra Ivanka Ioana Mihaela Andreea Alina Roxana Simona Raluca Gabriela
        Elif Ayşe Fatma Emine Hatice Zeynep Merve Esra Özlem Büşra Kübra Selin Defne Ebru Gül Sevgi
        Erzsébet Katalin Ilona Zsuzsanna Judit Eszter Ágnes Éva Mária Anikó Tünde Réka Orsolya Dóra
        Olga Irina Natalia Natalya Tatyana Svetlana Ekaterina Yekaterina Anastasia Galina Lyudmila Yulia Oksana Larisa Ksenia Darya
        Polina Marina Valentina Vera Nadezhda Oleksandra Kateryna Yana Iryna Olena
        Fatima Aisha Khadija Maryam Mariam Zainab Layla Leila Amina Nour Noor Hana Salma Yasmin Yasmine Samira Farah Huda Rania Dina
        Aaliyah Zahra Nadia Soraya Shirin Parisa Roya Maryam Nasrin Mahsa Sadaf Ayesha Sana Hina Zara Rabia Bushra
        Priya Anjali Pooja Neha Divya Deepika Kavita Sunita Anita Lakshmi Aishwarya Shreya Ananya Meera Sita Radha Rekha Nisha Swati
        Sneha Shalini Ritu Geeta Indira Kamala Padma Usha Vidya Lata Asha Aarti Kiran Manisha
        Yuki Sakura Hanako Yoko Keiko Akiko Naoko Tomoko Michiko Yumi Emi Ayumi Haruka Misaki Aoi Hina Kaori Megumi Noriko Reiko
        Mei Xiu Ying Yan Fang Xiaoyan Lihua Meiling Xiaoling Jing Yifei Minji Jiwoo Seoyeon Soyeon Hyejin Eunji Jisoo Yuna
        Thuy Huong Lan Linh Ngoc Siti Dewi Putri Ayu Nurul Wati Malee Somying Maribel Rosalinda Marisol
        Amara Chidinma Ngozi Adaeze Chiamaka Folake Yetunde Abena Akosua Ama Efua Wanjiru Nyambura Achieng Thandiwe Nomsa Zanele Lindiwe
        Makena Zawadi Ifeoma Temitope Shira Tamar Noa Yael Rivka Miriam Avigail Michal""",
        """James Peter Thomas Daniel Martin Carlos Pierre Stefan Robert David Miguel Lukas
        John Michael William Richard Joseph Charles Christopher Matthew Anthony Mark Donald Steven Paul Andrew Joshua Kenneth Kevin
        Brian George Timothy Ronald Edward Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon
        Benjamin Samuel Gregory Alexander Frank Patrick Raymond Jack Dennis Jerry Tyler Aaron Jose Adam Nathan Henry Douglas Zachary
        Kyle Noah Ethan Jeremy Walter Keith Roger Terry Harold Sean Gerald Carl Dylan Arthur Lawrence Jesse Bryan Joe Billy
        Bruce Gabriel Logan Albert Willie Alan Juan Wayne Elijah Randy Roy Vincent Ralph Eugene Russell Bobby Mason Philip Louis
        Harry Oliver Oscar Simon Stuart Graham Neil Nigel Trevor Colin Derek Geoffrey Gordon Hugh Ian Jeremiah Leonard Malcolm
        Rupert Rowan Theodore Tobias Tom Tony Victor Fred Frederick Francis Ernest Edgar Edmund Duncan Dominic Desmond Clive
        Clifford Clarence Cedric Cameron Calvin Callum Bernard Barry Alfred Alistair Adrian Ben Bill Bob Chris Dan Dave Ed Greg Jim
        Jimmy Joel Johnny Ken Liam Luke Matt Mike Mitchell Nick Owen Pete Phil Ray Rick Rob Ron Sam Steve Ted Tim Howard Herbert
        Hector Isaac Ivan Jake Jamie Jared Jerome Julian Kurt Lance Leo Leon Lewis Lloyd Marcus Marvin Maurice Melvin Morgan Nathaniel
        Neal Oswald Reginald Rodney Ross Seth Shane Shaun Spencer Stanley Stewart Sidney Travis Warren Wesley Xavier Angus Fergus
        Hamish Lachlan Ewan Rory Declan Cormac Eoin Oisin Padraig Seamus Diarmuid Finn Gareth Rhys Dylan Emrys Ieuan Huw
        Hans Klaus Jürgen Wolfgang Dieter Manfred Uwe Günter Günther Horst Werner Helmut Heinz Gerhard Rainer Bernd Jörg Andreas
        Matthias Torsten Thorsten Markus Frank Ralf Jens Sven Dirk Holger Kai Karsten Olaf Heiko Tobias Sebastian Florian Felix Jonas
        Moritz Maximilian Niklas Fabian Tim Philipp Johannes Christoph Franz Josef Karl Otto Friedrich Wilhelm Heinrich Hermann Ludwig
        Rudolf Siegfried Walther Konrad Anton Emil Georg Gustav Jakob Johann Lorenz Reinhard Ulrich Volker Jan Lars Björn Axel
        Jean Michel Philippe Alain Jacques Bernard Claude François Gérard Christophe Laurent Nicolas Sébastien Stéphane Frédéric Thierry
        Olivier Pascal Éric Julien Guillaume Antoine Maxime Alexandre Mathieu Matthieu Baptiste Hugo Théo Lucas Étienne Yves Rémi René
        André Marcel Henri Louis Luc Benoît Damien Fabrice Gilles Jérôme Marc Raphaël Romain Vincent Xavier Yann Édouard Gaston Thibault
        José Antonio Manuel Francisco Javier Luis Ángel Jesús Alejandro Pablo Sergio Fernando Jorge Alberto Álvaro Diego Raúl Rafael
        Pedro Enrique Ramón Vicente Andrés Joaquín Eduardo Víctor Roberto Ignacio Jaime Mario Ricardo Emilio Julio
        Felipe Gonzalo Guillermo Hernán Esteban Mateo Matías Nicolás Rodrigo Tomás Gustavo Héctor Iván Óscar Rubén César Arturo Ernesto
        Giuseppe Giovanni Antonio Mario Luigi Francesco Angelo Vincenzo Pietro Salvatore Carlo Franco Domenico Bruno Paolo Michele
        Giorgio Aldo Marco Luca Andrea Alessandro Matteo Lorenzo Davide Simone Federico Riccardo Stefano Fabio Massimo Claudio Roberto
        Maurizio Enrico Filippo Giacomo Leonardo Tommaso Nicola Gianluca Umberto Raffaele Gabriele Emanuele
        João Pedro Paulo Tiago Rui Nuno Gonçalo Afonso Duarte Luís Joaquim Vasco Thiago Bruno Fábio Márcio Marcelo Leandro Rodrigo
        Henrique Caio Vinícius Otávio Murilo Renato Flávio Sérgio Mauro
        Pieter Willem Hendrik Cornelis Gerrit Dirk Joost Jeroen Maarten Sander Bram Daan Sem Thijs Ruben Wouter Bart Kees Koen Niels
        Joris Floris Sjoerd Anders Erik Karl Lars Mikael Johan Nils Olof Gunnar Göran Magnus Fredrik Henrik Mattias Håkan Sven Björn
        Bengt Ulf Torbjörn Ole Knut Kjell Øyvind Sverre Trond Geir Svein Haakon Eirik Jens Søren Niels Mads Rasmus Kasper Jesper Morten
        Kristian Mikkel Juha Matti Timo Kari Antti Mika Jukka Pekka Heikki Tapani Eino Ville Petri Jari Jón Guðmundur Ólafur Einar
        Piotr Krzysztof Andrzej Tomasz Paweł Jan Michał Marcin Jakub Adam Stanisław Marek Łukasz Grzegorz Zbigniew Jerzy Tadeusz Mateusz
        Wojciech Dariusz Mariusz Rafał Kamil Kazimierz Janusz Maciej Bartosz Dawid Szymon Jiří Petr Josef Pavel Jaroslav Miroslav
        Zdeněk Václav Karel Vladimír Ondřej Tomáš Lukáš Marek Vojtěch Dušan Jozef Ján Štefan Nikola Marko Dragan Zoran
        Goran Nenad Dejan Aleksandar Vladimir Slobodan Bojan Luka Stjepan Ivo Ante Tomislav Mihai Andrei Alexandru Vasile Gheorghe
        Nicolae Florin Cristian Ionuț Radu Bogdan Mehmet Mustafa Ahmet Ali Hüseyin Hasan İbrahim Murat Ömer Emre Burak Yusuf Kemal Serkan
        László István Zoltán Gábor Attila Sándor Ferenc Tibor Péter Balázs Gergely Bence Ádám
        Ivan Sergey Sergei Alexei Alexey Dmitry Dmitri Nikolai Andrei Vladimir Mikhail Yuri Igor Oleg Boris Pavel Maxim Konstantin Viktor
        Anatoly Evgeny Yevgeny Roman Ruslan Stanislav Vadim Kirill Artem Oleksandr Volodymyr Andriy Mykola Vasyl Taras Bohdan Serhiy
        Mohammed Muhammad Mohamed Mohammad Ahmed Ahmad Ali Omar Umar Hassan Hussein Hussain Ibrahim Khalid Yusuf Youssef Mahmoud Mustafa
        Abdullah Abdul Karim Kareem Tariq Bilal Hamza Samir Walid Rashid Faisal Nasser Majid Jamal Amir Reza Hossein Mehdi Saeed Farhad
        Imran Usman Asif Zubair Salman Irfan Nadeem Waqar Shahid Iqbal
        Raj Rahul Amit Sanjay Rajesh Vijay Suresh Ramesh Anil Sunil Vikram Arjun Rohan Rohit Ravi Ashok Deepak Manoj Ajay Arun Krishna
        Ganesh Mahesh Nitin Sachin Vivek Karan Aditya Akash Abhishek Gaurav Harish Mukesh Naveen Prakash Pradeep Prashant Satish Siddharth
        Takashi Hiroshi Kenji Satoshi Takeshi Makoto Kazuo Yoshio Akira Haruto Ren Sota Daiki Kenta Shota Ryota Yuto Taro Ichiro Jiro Kaito
        Wei Jun Ming Lei Feng Hao Jianguo Xiaoming Zhiwei Yong Minjun Jihoon Seojun Hyunwoo Donghyun Sungmin Youngho Minho
        Nguyen Minh Tuan Hung Duc Quang Budi Agus Eko Joko Adi Somchai Anan Rodel Jomar
        Chukwuemeka Emeka Chinedu Obinna Ifeanyi Oluwaseun Babatunde Olumide Tunde Kwame Kofi Kwabena Yaw Kwasi Mwangi Kamau Otieno
        Ochieng Sipho Thabo Themba Bongani Mandla Tendai Farai Juma Baraka Moshe Yosef Avraham Yitzhak Shlomo Eitan Itai Uri Amos Avi"""),
    "cyrillic": _both(
        """Анна Мария Елена Ольга Ирина Наталья Татьяна Светлана Екатерина Анастасия Галина Людмила Юлия Оксана Лариса Ксения Дарья
        Полина Марина Валентина Вера Надежда Любовь Александра Евгения Виктория Алина Алла Антонина Валерия Вероника Диана Зинаида Зоя
        Инна Кристина Лидия Маргарита Нина Раиса Софья София Тамара Яна Наталия Алёна Нонна Олена Катерина Ірина Юлія Наталія Оксана
        Милица Јелена Драгана Снежана Весна Гордана Марија Десислава Цветелина Радка Йорданка""",
        """Иван Пётр Сергей Алексей Дмитрий Николай Петр Александр Андрей Владимир Михаил Юрий Игорь Олег Борис Павел Максим Константин
        Виктор Анатолий Евгений Роман Руслан Станислав Вадим Кирилл Артём Артем Денис Антон Василий Виталий Вячеслав Геннадий Георгий
        Григорий Даниил Егор Илья Леонид Лев Матвей Никита Степан Тимофей Фёдор Федор Ярослав Валерий Эдуард Семён Олександр Володимир
        Андрій Микола Василь Тарас Богдан Сергій Дмитро Петро Олексій Никола Марко Милан Драган Зоран Горан Георги Димитър Стоян"""),
    "greek": _both(
        """Μαρία Ελένη Άννα Σοφία Κατερίνα Αικατερίνη Βασιλική Γεωργία Δήμητρα Ειρήνη Ευαγγελία Ιωάννα Κωνσταντίνα Παναγιώτα Αναστασία
        Αγγελική Δέσποινα Χριστίνα Αλεξάνδρα Θεοδώρα Ζωή Όλγα Ευγενία Φωτεινή Στέλλα Νίκη""",
        """Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Γεώργιος Ιωάννης Κωνσταντίνος Δημήτριος Νικόλαος Παναγιώτης Βασίλης Βασίλειος Χρήστος
        Αθανάσιος Θανάσης Μιχάλης Μιχαήλ Ευάγγελος Βαγγέλης Σπύρος Σπυρίδων Αντώνης Αντώνιος Αναστάσιος Τάσος Θεόδωρος Ανδρέας Αλέξανδρος
        Πέτρος Στέλιος Μανώλης Ηλίας Σταύρος Λευτέρης Παύλος Στέφανος"""),
    "arabic": _both(
        "فاطمة عائشة خديجة مريم زينب ليلى أمينة سلمى ياسمين سميرة فرح هدى رانيا دينا زهرة نادية سارة آمنة رقية حنان إيمان منى سعاد",
        "محمد أحمد علي عمر حسن حسين إبراهيم خالد يوسف محمود مصطفى عبدالله كريم طارق بلال حمزة سمير وليد رشيد فيصل ناصر ماجد جمال أمير رضا سعيد"),
    "hebrew": _both(
        "שרה רחל רבקה לאה מרים תמר יעל מיכל נועה שירה אסתר חנה דבורה אביגיל רות",
        "משה יוסף אברהם יצחק יעקב דוד שלמה דניאל איתן איתי אורי עמוס אבי שמואל אליהו"),
    "devanagari": _both("सीता राधा गीता रेखा सुनीता अनीता कविता नेहा पूजा अंजलि", "राम राज राहुल अमित संजय राजेश विजय सुरेश रमेश अनिल"),
}
