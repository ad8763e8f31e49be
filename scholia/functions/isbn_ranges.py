"""The reference's built-in ISBN ranges (isbn.tbl of January 2013): 993 ranges of registration groups, in table order."""

#: A group on each line, and the first and last registrants of its ranges (fixed values).
_TABLE = """\
0 00-19 200-699 7000-8499 85000-89999 900000-949999 9500000-9999999
1 00-09 100-399 4000-5499 55000-86979 869800-998999 9990000-9999999
2 00-19 200-349 35000-39999 400-699 7000-8399 84000-89999 900000-949999 9500000-9999999
3 00-02 030-033 0340-0369 03700-03999 04-19 200-699 7000-8499 85000-89999 900000-949999 9500000-9539999 95400-96999 9700000-9899999 99000-99499 99500-99999
4 00-19 200-699 7000-8499 85000-89999 900000-949999 9500000-9999999
5 00000-00499 0050-0099 01-19 200-420 4210-4299 430-430 4310-4399 440-440 4410-4499 450-699 7000-8499 85000-89999 900000-909999 91000-91999 9200-9299 93000-94999 9500000-9500999 9501-9799 98000-98999 9900000-9909999 9910-9999
600 00-09 100-499 5000-8999 90000-99999
601 00-19 200-699 7000-7999 80000-84999 85-99
602 00-14 1500-1699 17000-17999 18000-18999 19000-19999 200-749 7500-7999 8000-9499 95000-99999
603 00-04 05-49 500-799 8000-8999 90000-99999
604 0-4 50-89 900-979 9800-9999
605 01-09 100-399 4000-5999 60000-89999 90-99
606 0-0 10-49 500-799 8000-9199 92000-99999
607 00-39 400-749 7500-9499 95000-99999
608 0-0 10-19 200-449 4500-6499 65000-69999 7-9
609 00-39 400-799 8000-9499 95000-99999
612 00-29 300-399 4000-4499 45000-49999 50-99
613 0-9
614 00-39 400-799 8000-9499 95000-99999
615 00-09 100-499 5000-7999 80000-89999
616 00-19 200-699 7000-8999 90000-99999
617 00-49 500-699 7000-8999 90000-99999
618 00-19 200-499 5000-7999 80000-99999
619 00-14 150-699 7000-8999 90000-99999
620 0-9
621 00-29 400-599 8000-8999 95000-99999
7 00-09 100-499 5000-7999 80000-89999 900000-999999
80 00-19 200-699 7000-8499 85000-89999 900000-999999
81 00-19 200-699 7000-8499 85000-89999 900000-999999
82 00-19 200-699 7000-8999 90000-98999 990000-999999
83 00-19 200-599 60000-69999 7000-8499 85000-89999 900000-999999
84 00-13 140-149 15000-19999 200-699 7000-8499 85000-89999 9000-9199 920000-923999 92400-92999 930000-949999 95000-96999 9700-9999
85 00-19 200-599 60000-69999 7000-8499 85000-89999 900000-979999 98000-99999
86 00-29 300-599 6000-7999 80000-89999 900000-999999
87 00-29 400-649 7000-7999 85000-94999 970000-999999
88 00-19 200-599 6000-8499 85000-89999 900000-909999 910-929 95000-99999
89 00-24 250-549 5500-8499 85000-94999 950000-969999 97000-98999 990-999
90 00-19 200-499 5000-6999 70000-79999 800000-849999 8500-8999 90-90 94-94
91 0-1 20-49 500-649 7000-7999 85000-94999 970000-999999
92 0-5 60-79 800-899 9000-9499 95000-98999 990000-999999
93 00-09 100-499 5000-7999 80000-94999 950000-999999
94 000-599 6000-8999 90000-99999
950 00-49 500-899 9000-9899 99000-99999
951 0-1 20-54 550-889 8900-9499 95000-99999
952 00-19 200-499 5000-5999 60-65 6600-6699 67000-69999 7000-7999 80-94 9500-9899 99000-99999
953 0-0 10-14 150-509 51-54 55000-59999 6000-9499 95000-99999
954 00-28 2900-2999 300-799 8000-8999 90000-92999 9300-9999
955 0000-1999 20-43 44000-44999 4500-4999 50000-54999 550-799 8000-9499 95000-99999
956 00-19 200-699 7000-9999
957 00-02 0300-0499 05-19 2000-2099 21-27 28000-30999 31-43 440-819 8200-9699 97000-99999
958 00-56 57000-59999 600-799 8000-9499 95000-99999
959 00-19 200-699 7000-8499 85000-99999
960 00-19 200-659 6600-6899 690-699 7000-8499 85000-92999 93-93 9400-9799 98000-99999
961 00-19 200-599 6000-8999 90000-94999
962 00-19 200-699 7000-8499 85000-86999 8700-8999 900-999
963 00-19 200-699 7000-8499 85000-89999 9000-9999
964 00-14 150-249 2500-2999 300-549 5500-8999 90000-96999 970-989 9900-9999
965 00-19 200-599 7000-7999 90000-99999
966 00-12 130-139 14-14 1500-1699 170-199 2000-2789 279-289 2900-2999 300-699 7000-8999 90000-90999 910-949 95000-97999 980-999
967 00-00 0100-0999 10000-19999 300-499 5000-5999 60-89 900-989 9900-9989 99900-99999
968 01-39 400-499 5000-7999 800-899 9000-9999
969 0-1 20-39 400-799 8000-9999
970 01-59 600-899 9000-9099 91000-96999 9700-9999
971 000-015 0160-0199 02-02 0300-0599 06-09 10-49 500-849 8500-9099 91000-95999 9600-9699 97-98 9900-9999
972 0-1 20-54 550-799 8000-9499 95000-99999
973 0-0 100-169 1700-1999 20-54 550-759 7600-8499 85000-88999 8900-9499 95000-99999
974 00-19 200-699 7000-8499 85000-89999 90000-94999 9500-9999
975 00000-01999 02-24 250-599 6000-9199 92000-98999 990-999
976 0-3 40-59 600-799 8000-9499 95000-99999
977 00-19 200-499 5000-6999 700-849 85000-89999 90-99
978 000-199 2000-2999 30000-79999 8000-8999 900-999
979 000-099 1000-1499 15000-19999 20-29 3000-3999 400-799 8000-9499 95000-99999
980 00-19 200-599 6000-9999
981 00-11 200-289 290-299 3000-3099 310-399 4000-9999
982 00-09 100-699 70-89 9000-9799 98000-99999
983 00-01 020-199 2000-3999 40000-44999 45-49 50-79 800-899 9000-9899 99000-99999
984 00-39 400-799 8000-8999 90000-99999
985 00-39 400-599 6000-8999 90000-99999
986 00-11 120-559 5600-7999 80000-99999
987 00-09 1000-1999 20000-29999 30-49 500-899 9000-9499 95000-99999
988 00-11 12000-14999 15000-16999 17000-19999 200-799 8000-9699 97000-99999
989 0-1 20-54 550-799 8000-9499 95000-99999
9927 00-09 100-399 4000-4999
9928 00-09 100-399 4000-4999
9929 0-3 40-54 550-799 8000-9999
9930 00-49 500-939 9400-9999
9931 00-29 300-899 9000-9999
9932 00-39 400-849 8500-9999
9933 0-0 10-39 400-899 9000-9999
9934 0-0 10-49 500-799 8000-9999
9935 0-0 10-39 400-899 9000-9999
9936 0-1 20-39 400-799 8000-9999
9937 0-2 30-49 500-799 8000-9999
9938 00-79 800-949 9500-9999
9939 0-4 50-79 800-899 9000-9999
9940 0-1 20-49 500-899 9000-9999
9941 0-0 10-39 400-899 9000-9999
9942 00-89 900-984 9850-9999
9943 00-29 300-399 4000-9999
9944 0000-0999 100-499 5000-5999 60-69 700-799 80-89 900-999
9945 00-00 010-079 08-39 400-569 57-57 580-849 8500-9999
9946 0-1 20-39 400-899 9000-9999
9947 0-1 20-79 800-999
9948 00-39 400-849 8500-9999
9949 0-0 10-39 400-899 9000-9999
9950 00-29 300-849 8500-9999
9951 00-39 400-849 8500-9999
9952 0-1 20-39 400-799 8000-9999
9953 0-0 10-39 400-599 60-89 9000-9999
9954 0-1 20-39 400-799 8000-9999
9955 00-39 400-929 9300-9999
9956 0-0 10-39 400-899 9000-9999
9957 00-39 400-699 70-84 8500-8799 88-99
9958 00-03 040-089 0900-0999 10-18 1900-1999 20-49 500-899 9000-9999
9959 0-1 20-79 800-949 9500-9699 970-979 98-99
9960 00-59 600-899 9000-9999
9961 0-2 30-69 700-949 9500-9999
9962 00-54 5500-5599 56-59 600-849 8500-9999
9963 0-1 20-24 250-279 2800-2999 30-54 550-734 7350-7499 7500-9999
9964 0-6 70-94 950-999
9965 00-39 400-899 9000-9999
9966 000-149 1500-1999 20-69 7000-7499 750-959 9600-9999
9967 00-39 400-899 9000-9999
9968 00-49 500-939 9400-9999
9970 00-39 400-899 9000-9999
9971 0-5 60-89 900-989 9900-9999
9972 00-09 1-1 200-249 2500-2999 30-59 600-899 9000-9999
9973 00-05 060-089 0900-0999 10-69 700-969 9700-9999
9974 0-2 30-54 550-749 7500-9499 95-99
9975 0-0 100-399 4000-4499 45-89 900-949 9500-9999
9976 0-5 60-89 900-989 9900-9999
9977 00-89 900-989 9900-9999
9978 00-29 300-399 40-94 950-989 9900-9999
9979 0-4 50-64 650-659 66-75 760-899 9000-9999
9980 0-3 40-89 900-989 9900-9999
9981 00-09 100-159 1600-1999 20-79 800-949 9500-9999
9982 00-79 800-989 9900-9999
9983 80-94 950-989 9900-9999
9984 00-49 500-899 9000-9999
9985 0-4 50-79 800-899 9000-9999
9986 00-39 400-899 9000-9399 940-969 97-99
9987 00-39 400-879 8800-9999
9988 0-2 30-54 550-749 7500-9999
9989 0-0 100-199 2000-2999 30-59 600-949 9500-9999
99901 00-49 500-799 80-99
99903 0-1 20-89 900-999
99904 0-5 60-89 900-999
99905 0-3 40-79 800-999
99906 0-2 30-59 600-699 70-89 90-94 950-999
99908 0-0 10-89 900-999
99909 0-3 40-94 950-999
99910 0-2 30-89 900-999
99911 00-59 600-999
99912 0-3 400-599 60-89 900-999
99913 0-2 30-35 600-604
99914 0-4 50-89 900-999
99915 0-4 50-79 800-999
99916 0-2 30-69 700-999
99917 0-2 30-89 900-999
99918 0-3 40-79 800-999
99919 0-2 300-399 40-69 70-79 800-849 850-899 900-999
99920 0-4 50-89 900-999
99921 0-1 20-69 700-799 8-8 90-99
99922 0-3 40-69 700-999
99923 0-1 20-79 800-999
99924 0-1 20-79 800-999
99925 0-3 40-79 800-999
99926 0-0 10-59 600-899 90-99
99927 0-2 30-59 600-999
99928 0-0 10-79 800-999
99929 0-4 50-79 800-999
99930 0-4 50-79 800-999
99931 0-4 50-79 800-999
99932 0-0 10-59 600-699 7-7 80-99
99933 0-2 30-59 600-999
99934 0-1 20-79 800-999
99935 0-2 30-59 600-699 7-8 90-99
99936 0-0 10-59 600-999
99937 0-1 20-59 600-999
99938 0-1 20-59 600-899 90-99
99939 0-5 60-89 900-999
99940 0-0 10-69 700-999
99941 0-2 30-79 800-999
99942 0-4 50-79 800-999
99943 0-2 30-59 600-999
99944 0-4 50-79 800-999
99945 0-5 60-89 900-999
99946 0-2 30-59 600-999
99947 0-2 30-69 700-959 96-99
99948 0-4 50-79 800-999
99949 0-1 20-89 900-999
99950 0-4 50-79 800-999
99952 0-4 50-79 800-999
99953 0-2 30-79 800-939 94-99
99954 0-2 30-69 700-879 88-99
99955 0-1 20-59 600-799 80-89 90-99
99956 00-59 600-859 86-99
99957 0-1 20-79 800-999
99958 0-4 50-94 950-999
99959 0-2 30-59 600-999
99960 0-0 10-94 950-999
99961 0-3 40-89 900-999
99962 0-4 50-79 800-999
99963 00-49 500-999
99964 0-1 20-79 800-999
99965 0-3 40-79 800-999
99966 0-2 30-69 700-799
99967 0-1 20-59 600-899
99968 0-3 400-599 60-89 900-999
99969 0-4 50-79 800-999
99970 0-4 50-89 900-999
99971 0-5 60-84 850-999
99972 0-4 50-89 900-999
10 00-19 200-699 7000-8999 90000-97599 976000-999999
11 00-24 250-549 5500-8499 85000-94999 950000-999999
"""

#: First and last registrant prefixes.
ISBN_RANGES: list[tuple[str, str]] = [(f"{group}-{r.split('-')[0]}", f"{group}-{r.split('-')[1]}") for group, *ranges in map(str.split, _TABLE.splitlines()) for r in ranges]
