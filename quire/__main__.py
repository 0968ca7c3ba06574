from quire.workflow import main

main()
