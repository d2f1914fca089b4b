from turnwise.plans.modes import main

main()
