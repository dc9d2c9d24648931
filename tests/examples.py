"""Five known events, fixed values: (command line, image, prompt, row hash, group key, features)."""

EXAMPLES = [
    (
        '"C:\\Windows\\System32\\msedge.exe" --profile-directory=Default --app-id=ojkdgjmjkeckkefkeoipbmjldmapjald',
        'C:\\Windows\\System32\\msedge.exe',
        '[2025-11-03 16:24:30] | PID=7890 | User=CORP\\jsmith | Image=C:\\Windows\\System32\\msedge.exe | Parent=C:\\Windows\\explorer.exe | CMD="C:\\Windows\\System32\\msedge.exe" --profile-directory=Default --app-id=ojkdgjmjkeckkefkeoipbmjldmapjald',
        'e03bcaa5987eeab88ba4970b715eaf961203d85ace41a35a3da2897477942e3d',
        'c:\\windows\\system32\\msedge.exe::"c:\\windows\\system32\\msedge.exe" --profile-<B64> --app-<B64>',
        (102, 3, 0, 0.048193, 2, 'msedge.exe', '"c:\\windows\\system32\\msedge.exe"', 3, set()),
    ),
    (
        '"C:\\Program Files\\Wireshark\\Wireshark.exe"',
        'C:\\Program Files\\Wireshark\\Wireshark.exe',
        '[2025-10-25 21:10:45] | PID=4567 | User=CORP\\jsmith | Image=C:\\Program Files\\Wireshark\\Wireshark.exe | Parent=C:\\Windows\\explorer.exe | CMD="C:\\Program Files\\Wireshark\\Wireshark.exe"',
        '691d7c67b0c799f7b225170172c6420d14fa1df3d6c171dc96b5cb084afa8376',
        'c:\\program files\\wireshark\\wireshark.exe::c:\\program files\\wireshark\\wireshark.exe',
        (42, 2, 0, 0.147059, 0, 'wireshark.exe', '"c:\\program', 3, set()),
    ),
    (
        'attrib +h +s C:\\Users\\Public\\Documents\\suspicious.dll',
        'C:\\Windows\\System32\\attrib.exe',
        '[2020-05-01 22:56:35] | PID=1256 | User=NT AUTHORITY\\NETWORK SERVICE | Image=C:\\Windows\\System32\\attrib.exe | Parent=C:\\Windows\\explorer.exe | CMD=attrib +h +s C:\\Users\\Public\\Documents\\suspicious.dll',
        '9e9df58a180b0eb1d75a3f6618da9d616c845a203de05065e553b23c03e5af21',
        'c:\\windows\\system32\\attrib.exe::attrib +h +s c:\\users\\public\\documents\\suspicious.dll',
        (53, 4, 0, 0.095238, 0, 'attrib.exe', 'attrib', 3, set()),
    ),
    (
        'reg save HKLM\\SAM C:\\ProgramData\\sam.hiv',
        'C:\\Windows\\System32\\reg.exe',
        '[2020-05-01 22:57:04] | PID=1027 | User=NT AUTHORITY\\NETWORK SERVICE | Image=C:\\Windows\\System32\\reg.exe | Parent=C:\\Windows\\explorer.exe | CMD=reg save HKLM\\SAM C:\\ProgramData\\sam.hiv',
        '88db773cc4475d71e04fc5f94b436719d73cd271589084b706c018a11c268406',
        'c:\\windows\\system32\\reg.exe::reg save hklm\\sam c:\\programdata\\sam.hiv',
        (40, 4, 0, 0.3125, 0, 'reg.exe', 'reg', 3, set()),
    ),
    (
        'cmd.exe /c wmic /node:DESKTOP-TARGET process call create "powershell.exe -Command \\"whoami > C:\\Users\\Public\\whoami.txt\\""',
        'C:\\Windows\\System32\\cmd.exe',
        '[2020-05-01 22:56:05] | PID=1048 | User=NT AUTHORITY\\SYSTEM | Image=C:\\Windows\\System32\\cmd.exe | Parent=C:\\Windows\\explorer.exe | CMD=cmd.exe /c wmic /node:DESKTOP-TARGET process call create "powershell.exe -Command \\"whoami > C:\\Users\\Public\\whoami.txt\\""',
        '5a29802a7d7820945f7a0b2e060142c8565b320873ed37ed432bc66f18a18c84',
        'c:\\windows\\system32\\cmd.exe::cmd.exe /c wmic /node:desktop-target process call create "powershell.exe -command \\"whoami > c:\\users\\public\\whoami.txt\\""',
        (122, 12, 0, 0.184783, 0, 'cmd.exe', 'cmd.exe', 3, {'has_cmd', 'has_powershell', 'has_wmic'}),
    ),
]
