from toponymic.plans.run import main

main()
